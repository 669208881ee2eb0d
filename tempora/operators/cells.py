"""Samples to cells of a grid: intervals, look-back windows and overlapping windows.

A grid has the instants start + k * step for 0 <= k < n. Each function adds `k` to the rows, once for each cell that a row feeds;
one hash aggregation by k follows, with partial sums where the samples are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.times import cells


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient rounded down, in integers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def ceil_div(a: Column, b: int) -> Column:
    return -floor_div(-a, b)


def trunc_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def interval(df: DataFrame, t: Column, start: int, stop: int, step: int) -> DataFrame:
    """Cell k has the rows from start + k * step on, up to the next."""
    return df.where(t.between(start, stop)).withColumn("k", floor_div(t - start, step))


def window(df: DataFrame, t: Column, start: int, stop: int, step: int, width: int) -> DataFrame:
    """Cell k looks back `width` from its instant, which belongs to it.

    The low edge belongs to a window longer or shorter than the step, and not to one as long as it.
    """
    first = ceil_div(t - start, step)
    rows = df.where(t.between(start - width, stop))
    if width > step:
        rows = rows.withColumn("k", F.explode(F.sequence(first, F.greatest(first, floor_div(t + width - start, step)))))
    elif width < step:
        rows = rows.withColumn("k", first).where(t + width >= start + F.col("k") * step)
    else:
        rows = rows.withColumn("k", first)
    return rows.where(F.col("k").between(0, cells(start, stop, step) - 1))


def rollup_interval(df: DataFrame, granularity: int, start: int, stop: int, step: int) -> DataFrame:
    """A rollup row counts where its middle lies; the step before the first cell is part of it."""
    middle = F.col("bucket_ms") + granularity // 2
    return df.where(middle.between(start - step, stop + step)).withColumn("k", trunc_div(middle - start, step)).where(F.col("k").between(0, cells(start, stop, step) - 1))


def rollup_window(df: DataFrame, granularity: int, start: int, stop: int, step: int, width: int) -> DataFrame:
    """The windows by the middles of rollup rows; one not longer than the step takes what the step ends with."""
    middle = F.col("bucket_ms") + granularity // 2
    first = ceil_div(middle - start, step)
    rows = df.where(middle.between(start - width, stop + step))
    last = F.greatest(first, floor_div(middle + width - start, step)) if width > step else first
    return rows.withColumn("k", F.explode(F.sequence(first, last))).where(F.col("k").between(0, cells(start, stop, step) - 1))


def overlapping(df: DataFrame, t: Column, stop: int, step: int, windows: list[int]) -> DataFrame:
    """Adds `time` for each of the windows, in steps back from the last full step, that holds the row; both edges are outside."""
    end = stop // step * step
    longest = max(windows)
    starts = F.array(*[F.lit(end - w * step) for w in sorted(set(windows), reverse=True)])
    return df.where((t > end - longest * step) & (t < end)).withColumn("time", F.explode(F.filter(starts, lambda s: s < t)))

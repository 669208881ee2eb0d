"""Series sampled at the instants of a grid, and aggregates across series.

The value of a series at an instant is that of a sample right there, or else what an interpolator makes of the samples around
it. An instant that no sample follows has no value. Every sample brings the instants from the one before it (which that one
doesn't reach) up to itself, so no dense grid is ever built: one window over a stretch of time to see the sample before, then an
explode that the tolerance bounds for all interpolators but `none` and `nan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.interpolate import between
from tempora.functions.times import DAY
from tempora.operators.cells import ceil_div, floor_div

#: Instants that one gap between two samples may fill.
MAX_CELLS = 11_000_000
#: Milliseconds of a series that one task looks at, and instants that are written out at a time.
STRETCH, PART = 35 * DAY, 10_000


def _after(samples: DataFrame, value: str, low: int, stop: int) -> DataFrame:
    """metric, labels, lset, t_ms and the value of each sample from low to stop, with the time and value of the one before it in its series, t0 and v0.

    Of samples at one time the first by value counts. Where the range is longer than one stretch of time, a series is dealt by
    stretches, so a long one is many tasks' work: what comes before a stretch's first sample is the last sample of the stretches
    before it, one row for each stretch.
    """
    rows = samples.where(F.col("t_ms").between(low, stop) & F.col(value).isNotNull()).select("metric", "labels", "lset", "t_ms", value, floor_div(F.col("t_ms") - low, STRETCH).alias("stretch"))
    if stop - low < STRETCH:
        whole = Window.partitionBy("metric", "lset").orderBy("t_ms")
        first = rows.withColumn(value, F.min(value).over(whole.rangeBetween(0, 0)))
        after = first.select("metric", "labels", "lset", "t_ms", value, F.lag("t_ms").over(whole).alias("t0"), F.lag(value).over(whole).alias("v0"))
        return after.where("t0 IS NULL OR t0 < t_ms")
    ends = rows.groupBy("metric", "lset", "stretch").agg(F.max("t_ms").alias("end_t"), F.min(F.struct(-F.col("t_ms"), value)).alias("end"))
    before = Window.partitionBy("metric", "lset").orderBy("stretch")
    carried = ends.select("metric", "lset", "stretch", F.lag("end_t").over(before).alias("carried_t"), F.lag(F.col("end")[value]).over(before).alias("carried_v"))
    own = Window.partitionBy("metric", "lset", "stretch").orderBy("t_ms")
    first = rows.join(carried, ["metric", "lset", "stretch"]).withColumn(value, F.min(value).over(own.rangeBetween(0, 0)))
    t0, v0 = F.lag("t_ms").over(own), F.lag(value).over(own)
    after = first.select("metric", "labels", "lset", "t_ms", value, F.coalesce(t0, "carried_t").alias("t0"), F.when(t0.isNull(), F.col("carried_v")).otherwise(v0).alias("v0"))
    return after.where("t0 IS NULL OR t0 < t_ms")


def _listed(first: Column, last: Column) -> Column:
    """The instants from first to last as an array, where it is known to be short."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _spans(first: Column, last: Column) -> Column:
    """The instants from first to last as an array of spans (k0, k1) of PART at most."""
    none = F.array().cast("array<struct<k0:bigint,k1:bigint>>")
    cut = F.transform(F.sequence(first, last, F.lit(PART).cast("long")), lambda k: F.struct(k.alias("k0"), F.least(k + (PART - 1), last).alias("k1")))
    return F.when(first <= last, cut).otherwise(none)


def _instants(rows: DataFrame, spans: Column) -> DataFrame:
    """A row for each k of the spans; a long gap is written out part by part, so no array is long."""
    return rows.withColumn("span", F.explode(spans)).withColumn("k", F.explode(F.sequence("span.k0", "span.k1"))).drop("span")


def sampled(samples: DataFrame, start: int, stop: int, step: int, interpolator: str, tolerance: int) -> DataFrame:
    """metric, labels, lset, k, v: the values of each numeric series at the grid. Samples before `start` may come before a first one."""
    if (stop - start) // step >= MAX_CELLS:
        raise ValueError(f"a grid of more than {MAX_CELLS} instants; choose a longer step")
    rows = _after(samples, "v", start - tolerance, stop)  # what is older is no value's neighbour
    t, t0 = F.col("t_ms"), F.col("t0")
    last = floor_div(t - start, step)
    first = F.greatest(F.coalesce(floor_div(t0 - start, step) + 1, F.lit(0).cast("long")), F.lit(0).cast("long"))
    exact = last * step + start == t
    if interpolator in ("next_val", "linear"):
        first = F.greatest(first, ceil_div(t - tolerance - start, step))
    short = interpolator in ("prev_val", "next_val", "linear") and tolerance // step < PART
    made = _listed if short else _spans
    instants = made(first, last)
    if interpolator == "prev_val":
        reach = F.least(F.coalesce(floor_div(t0 + tolerance - start, step), F.lit(-1).cast("long")), F.when(exact, last - 1).otherwise(last))
        instants = F.concat(made(first, reach), F.when(exact, made(F.greatest(first, last), last)).otherwise(made(F.lit(1).cast("long"), F.lit(0).cast("long"))))
    at = rows.withColumn("k", F.explode(instants)) if short else _instants(rows, instants)
    g = F.col("k") * step + start
    value = F.when(g == t, F.col("v")).otherwise(between(interpolator, g, t0, F.col("v0"), t, F.col("v"), tolerance))
    return at.select("metric", "labels", "lset", "k", value.alias("v")).where("v IS NOT NULL")


def sampled_text(samples: DataFrame, start: int, stop: int, step: int, tolerance: int | None) -> DataFrame:
    """The same for text series, which have a next value only: metric, labels, lset, k, s."""
    rows = _after(samples, "s", start, stop)
    last = floor_div(F.col("t_ms") - start, step)
    first = F.greatest(F.coalesce(floor_div(F.col("t0") - start, step) + 1, F.lit(0).cast("long")), F.lit(0).cast("long"))
    if tolerance is not None:
        first = F.greatest(first, ceil_div(F.col("t_ms") - tolerance - start, step))
    return _instants(rows, _spans(first, last)).select("metric", "labels", "lset", "k", "s")

"""Aggregation of cells, by metric in columns, and what is computed from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.aggregates import NEEDS, PRIMITIVES, derived, finite, over_rollups, over_samples
from tempora.functions.labels import lset_of, subset

#: (output name, metric, function) of a column.
Wanted = list[tuple[str, str, str]]


def primitives(rows: DataFrame, keys: list[Column | str], wanted: Wanted, rolled: bool = False, by_metric: bool = True) -> tuple[DataFrame, dict]:
    """One row for each combination of keys with every primitive that the columns need, and the names they have."""
    need = sorted({(m, p) for _, m, f in wanted for p in NEEDS[f]})
    names = {x: f"_p{i}" for i, x in enumerate(need)}
    order = F.struct("t_ms", "lset")
    made = []
    for (metric, p), name in names.items():
        given = F.col("metric") == metric if by_metric else F.lit(True)
        made.append((over_rollups(p, given) if rolled else over_samples(p, given, F.col("v"), order)).alias(name))
    if "labels" in rows.columns and "labels" not in keys:
        made.append(F.any_value("labels").alias("labels"))
    return rows.groupBy(*keys).agg(*made), names


def aggregate(rows: DataFrame, keys: list[Column | str], wanted: Wanted, step: int, rolled: bool = False, by_metric: bool = True) -> DataFrame:
    """The columns over groups of keys, of rows that have k where keys name it; a column without a sample is null.

    rate is the difference of the last values of a cell and of the cell right before it, by the second.
    """
    grouped, names = primitives(rows, keys, wanted, rolled, by_metric)
    own = [c for c in grouped.columns if not c.startswith("_p")]
    series = [c for c in own if c not in ("k", "labels")]
    before = Window.partitionBy(*series).orderBy("k")
    out = []
    for name, metric, function in wanted:
        part = {p: F.col(names[metric, p]) for p in NEEDS[function]}
        if function == "rate":
            last = part["last"]
            value = F.when(F.lag("k").over(before) == F.col("k") - 1, (last - F.lag(last).over(before)) / (step / 1000.0))
        else:
            value = derived(function, part)
        out.append(value.alias(name))
    return grouped.select(*own, *out)


def rolled_up(samples: DataFrame, granularity: int, before: Sequence[Column] = ()) -> DataFrame:
    """Rollup rows, after columns that follow from bucket_ms: all primitives of each series and bucket. Text isn't rolled up; values that aren't finite stay out of the sums."""
    bucket = F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(granularity))
    v, x = F.col("v"), finite(F.col("v"))
    return samples.where("v IS NOT NULL").withColumn("bucket_ms", bucket).groupBy(*before, "metric", "lset", "bucket_ms").agg(
        F.any_value("labels").alias("labels"), F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sqr"),
        F.max(v).alias("max"), F.min(v).alias("min"), F.max_by(v, F.struct("t_ms", v)).alias("last"), F.max("t_ms").alias("last_t"),
    )


def merged(rollups: DataFrame) -> DataFrame:
    """Rollup rows of one series and bucket made one, as after a union of old and new."""
    return rollups.groupBy("metric", "lset", "bucket_ms").agg(
        F.any_value("labels").alias("labels"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("sqr").alias("sqr"),
        F.max("max").alias("max"), F.min("min").alias("min"), F.max_by("last", F.struct("last_t", "last")).alias("last"), F.max("last_t").alias("last_t"),
    )


def over_labels(rollups: DataFrame, names: list[str]) -> DataFrame:
    """Rollup rows by a subset of the labels: a pre-aggregate. Series that lack one of the labels are left out."""
    has = F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.map_contains_key("labels", n)) if names else F.lit(True)
    return merged(rollups.where(has).withColumn("lset", lset_of(F.col("labels"), names)).withColumn("labels", subset(F.col("labels"), names)))


__all__ = ["PRIMITIVES", "Wanted", "aggregate", "merged", "over_labels", "primitives", "rolled_up"]

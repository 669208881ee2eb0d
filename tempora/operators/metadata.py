"""Names, labels and series of a table of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_names(samples: DataFrame) -> DataFrame:
    return samples.select("metric").distinct()


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(F.col("labels")[label].alias("value")).where("value IS NOT NULL").distinct()


def label_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_sets(samples: DataFrame, metric: str | None = None) -> DataFrame:
    rows = samples if metric is None else samples.where(F.col("metric") == metric)
    return rows.groupBy("metric", "lset").agg(F.any_value("labels").alias("labels")).select("metric", "labels", "lset")


def count_series(samples: DataFrame, partition_ms: int) -> DataFrame:
    """How many series there are, each counted once for every partition it has samples in."""
    part = (F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(partition_ms))).alias("part_start")
    return samples.select(part, "metric", "lset").distinct().agg(F.count(F.lit(1)).alias("series"))

"""Raw samples of several metrics side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aligned(samples: DataFrame, columns: list[tuple[str, str]], text: frozenset[str] = frozenset()) -> DataFrame:
    """labels, lset, time and a column (name, metric) for each metric: the union of the times of each label set, with null where a metric has no sample.

    One aggregation by label set and time does what a full outer join for each metric would. A metric in `text` gives strings. Of
    samples of one series at one time the first by value counts, as where a table takes them.
    """
    made = [F.min(F.when(F.col("metric") == m, F.col("s" if m in text else "v"))).alias(name) for name, m in columns]
    return samples.where(F.col("metric").isin([m for _, m in columns])).groupBy("lset", F.col("t_ms").alias("time")).agg(F.any_value("labels").alias("labels"), *made).select("labels", "lset", "time", *[n for n, _ in columns])


def merged_columns(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames with the same keys and different columns, joined outer."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full")
    return out

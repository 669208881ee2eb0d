"""The canonical table of samples, and adapters to it.

metric STRING, labels MAP<STRING, STRING>, lset STRING (the labels as text), t_ms BIGINT, v DOUBLE, s STRING: one of v and s.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.labels import labels_from_text, lset, valid_metric

SCHEMA = "metric string, labels map<string,string>, lset string, t_ms long, v double, s string"
COLUMNS = ("metric", "labels", "lset", "t_ms", "v", "s")
#: Times from 1970 to the year 2400.
MIN_TIME, MAX_TIME = 0, 13_569_465_600_000


def canonical(df: DataFrame, metric: Column, labels: Column, t_ms: Column, v: Column | None = None, s: Column | None = None) -> DataFrame:
    """Any table as samples. Numbers of every type become DOUBLE."""
    got = df.select(metric.cast("string").alias("metric"), labels.alias("labels"), t_ms.cast("long").alias("t_ms"), (F.lit(None) if v is None else v).cast("double").alias("v"), (F.lit(None) if s is None else s).cast("string").alias("s"))
    return got.select("metric", "labels", lset(F.col("labels")).alias("lset"), "t_ms", "v", "s")


def label_map(**columns: Column | str) -> Column:
    names = sorted(columns)
    return F.create_map(*[x for n in names for x in (F.lit(n), (F.col(columns[n]) if isinstance(columns[n], str) else columns[n]).cast("string"))])


def millis(ts: str) -> Column:
    """Milliseconds of a timestamp, with or without zone, read as UTC and rounded down."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def from_events(df: DataFrame) -> DataFrame:
    return canonical(df, F.col("event_type"), label_map(user_id="user_id"), millis("ts"), F.col("value"))


def from_lineitem(df: DataFrame) -> DataFrame:
    return canonical(df, F.col("l_returnflag"), label_map(linestatus="l_linestatus"), millis("l_shipdate"), F.col("l_extendedprice"))


def from_orders(df: DataFrame) -> DataFrame:
    return canonical(df, F.col("o_orderstatus"), label_map(priority="o_orderpriority"), millis("o_orderdate"), F.col("o_totalprice"))


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, dict[str, str], int, float | str | None]]) -> DataFrame:
    """Samples (metric, labels, time, value) given one by one."""
    data = [(m, dict(sorted(ls.items())), t, None if isinstance(x, str) else None if x is None else float(x), x if isinstance(x, str) else None) for m, ls, t, x in rows]
    df = spark.createDataFrame(data, "metric string, labels map<string,string>, t_ms long, v double, s string")
    return df.select("metric", "labels", lset(F.col("labels")).alias("lset"), "t_ms", "v", "s")


def _typed(value: Column) -> tuple[Column, Column]:
    number = value.try_cast("double")
    return number, F.when(number.isNull(), value)


def read_csv(spark: SparkSession, path: str, now: int | None = None) -> DataFrame:
    """Lines of metric, labels (k=v,k=v), value and, in a fourth column, time in milliseconds; a blank time is `now`."""
    from tempora.functions.times import now_ms

    lines = spark.read.csv(path, schema="metric string, labels string, value string, time string", header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    v, s = _typed(F.col("value"))
    t = F.coalesce(F.when(F.trim("time") != "", F.col("time").cast("long")), F.lit(now_ms() if now is None else now))
    return canonical(lines, F.col("metric"), labels_from_text(F.col("labels")), t, v, s)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Objects {metric, labels, samples: [{t, v: {n}}]}, one a line."""
    return from_json(spark.read.text(path).withColumnRenamed("value", "json"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """The same from a column of text, of a batch or a stream."""
    kind = "metric string, labels map<string,string>, samples array<struct<t:string,v:struct<n:double,s:string>>>"
    one = df.select(F.from_json(column, kind).alias("e")).select("e.metric", "e.labels", F.explode("e.samples").alias("x"))
    labels = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>"))
    return canonical(one, F.col("metric"), labels, F.col("x.t"), F.col("x.v.n"), F.col("x.v.s"))


def from_arrays(spark: SparkSession, metric: str, labels: str, values: str, times: str = "", now: int | None = None) -> DataFrame:
    """Comma lists of values and times for one series; after a first number all values must be numbers, and no time means now."""
    from tempora.functions.labels import check_metric, parse_labels
    from tempora.functions.times import now_ms, parse_time

    at = now_ms() if now is None else now
    vs = [x.strip() for x in values.split(",")]
    ts = [parse_time(x, at) for x in times.split(",")] if times.strip() else [at] * len(vs)
    if len(ts) != len(vs):
        raise ValueError(f"{len(vs)} values but {len(ts)} times")

    def number(x: str) -> float | None:
        try:
            return float(x)
        except ValueError:
            return None

    numeric = number(vs[0]) is not None
    if any((number(x) is not None) != numeric for x in vs):
        raise ValueError("the values of a series are either all numbers or all text")
    return from_rows(spark, [(check_metric(metric), parse_labels(labels), t, float(x) if numeric else x) for t, x in zip(ts, vs, strict=True)])


def fault() -> Column:
    """Why a sample can't be stored; null if it can."""
    both = F.col("v").isNotNull() & F.col("s").isNotNull()
    return F.when(F.col("metric").isNull() | ~valid_metric(F.col("metric")), "bad metric name").when(F.col("t_ms").isNull() | ~F.col("t_ms").between(MIN_TIME, MAX_TIME), "time out of range").when(both | (F.col("v").isNull() & F.col("s").isNull()), "no value, or two")


def faults(df: DataFrame) -> DataFrame:
    """Samples that can't be stored, with the reason."""
    return df.withColumn("reason", fault()).where("reason IS NOT NULL")

"""From a checked query to a DataFrame.

All plans are lazy; nothing is collected. The predicates on metric, time and, for tables, on part_start reach the scan. Where a
query asks for rollups and they can serve it, they do; their cells are those of the rollup rows' middles, so they are never
chosen unasked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.aggregates import NEEDS, derived, over_samples
from tempora.functions.labels import lset_of, subset
from tempora.operators import cells as C
from tempora.operators.aggregate import Wanted, aggregate
from tempora.operators.align import aligned, merged_columns
from tempora.operators.grid import sampled, sampled_text
from tempora.plans.filters import parse_filter
from tempora.plans.spec import Query, resolved

#: Rollups serve a query from so many of their buckets in a step on.
MIN_BUCKETS_A_STEP = 3


def rollups_fit(query: Query, granularity: int, stored: list[str], client: bool = True) -> bool:
    """Whether rollup rows of a granularity can answer a query: all primitives are stored, the step is long enough and a window no shorter than a bucket."""
    if not granularity or query.kind not in ("cells",) or any(c.base == "rate" for c in query.columns):
        return False
    need = {p for c in query.columns for p in NEEDS[c.base]}
    step_ok = query.step / granularity > MIN_BUCKETS_A_STEP or not client and query.step == granularity
    return need <= set(stored) and step_ok and (not query.window or query.window >= granularity)


def scoped(samples: DataFrame, query: Query, before: int = 0) -> DataFrame:
    """Samples of the query's metrics, filter and time range, which may start earlier."""
    rows = samples
    metrics = sorted({c.metric for c in query.columns})
    if not any(c.wildcard for c in query.columns):
        rows = rows.where(F.col("metric").isin(metrics))
    rows = rows.where(F.col("t_ms").between(query.start - before, query.stop))
    condition = parse_filter(query.filter)
    return rows if condition is None else rows.where(condition)


def _grouped(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows under the labels to group by; a row that lacks one makes the query fail."""
    if not names:
        return rows
    has = reduce(lambda a, b: a & b, [F.map_contains_key("labels", n) for n in names])
    message = F.lit(f"a series lacks a label of the grouping {', '.join(names)}")
    checked = F.when(has, subset(F.col("labels"), names)).otherwise(F.raise_error(message).cast("map<string,string>"))
    return rows.withColumn("lset", lset_of(F.col("labels"), names)).withColumn("labels", checked)


def _cells(rows: DataFrame, query: Query, t: F.Column) -> DataFrame:
    if query.window:
        return C.window(rows, t, query.start, query.stop, query.step, query.window)
    return C.interval(rows, t, query.start, query.stop, query.step)


def _timed(df: DataFrame, query: Query) -> DataFrame:
    rest = [c for c in df.columns if c not in ("k", "labels", "lset", "metric")]
    return df.select(*[c for c in ("metric", "labels", "lset") if c in df.columns], (F.col("k") * query.step + query.start).alias("time"), *rest)


def _over_cells(rows: DataFrame, query: Query, columns, rolled: bool) -> DataFrame:  # noqa: ANN001
    """A row for each label set and cell."""
    wild = columns[0].wildcard
    wanted: Wanted = [(c.base if wild else c.name, c.metric, c.base) for c in columns]
    keys = [*(["metric"] if wild else []), "lset", "k"]
    return aggregate(rows, keys, wanted, query.step, rolled, by_metric=not wild)


def _sampled(samples: DataFrame, query: Query, columns) -> DataFrame:  # noqa: ANN001
    """metric, lset, k and v of the columns' metrics, each with its own interpolator, in a pass for each different one."""
    parts = []
    for key in sorted({(c.interpolator, c.tolerance) for c in columns}):
        own = [c.metric for c in columns if (c.interpolator, c.tolerance) == key]
        rows = samples if columns[0].wildcard else samples.where(F.col("metric").isin(own))
        parts.append(sampled(rows, query.start, query.stop, query.step, *key))
    return reduce(DataFrame.unionByName, parts)


def _downsampled(samples: DataFrame, query: Query, columns, text: frozenset[str] = frozenset()) -> DataFrame:  # noqa: ANN001
    if columns[0].wildcard:
        return _sampled(samples, query, columns).select("metric", "labels", "lset", "k", F.col("v").alias("value"))

    def frame(values: DataFrame, own, value: str) -> DataFrame:  # noqa: ANN001
        made = [F.max(F.when(F.col("metric") == c.metric, F.col(value))).alias(c.name) for c in own]
        return values.groupBy("lset", "k").agg(F.any_value("labels").alias("labels"), *made)

    frames = []
    if numbers := [c for c in columns if c.metric not in text]:
        frames.append(frame(_sampled(samples, query, numbers), numbers, "v"))
    for c in columns:
        if c.metric in text:
            rows = samples.where(F.col("metric") == c.metric)
            frames.append(frame(sampled_text(rows, query.start, query.stop, query.step, None if c.interpolator == "none" else c.tolerance), [c], "s"))
    if len(frames) == 1:
        return frames[0]
    both = merged_columns([f.withColumnRenamed("labels", f"_labels{i}") for i, f in enumerate(frames)], ["lset", "k"])
    return both.select("lset", "k", F.coalesce(*[f"_labels{i}" for i in range(len(frames))]).alias("labels"), *[c.name for c in columns])


def _across(samples: DataFrame, query: Query) -> DataFrame:
    """One row for each grid instant, or for each of a group: every series is sampled first, and the values are aggregated. The last one is that of the last label set."""
    values = _grouped(_sampled(samples, query, query.columns).withColumn("t_ms", F.col("k")).withColumn("series", F.col("lset")), query.group_by)
    wild = query.columns[0].wildcard
    keys = [*(["metric"] if wild else []), *(["lset"] if query.group_by else []), "k"]
    made = []
    for c in query.columns:
        given = F.lit(True) if wild else F.col("metric") == c.metric
        part = {p: over_samples(p, given, F.col("v"), F.struct("t_ms", "metric", "series")) for p in NEEDS[c.base]}
        made.append(derived(c.base, part).alias(c.base if wild else c.name))
    if query.group_by:
        made.append(F.any_value("labels").alias("labels"))
    return values.groupBy(*keys).agg(*made)


def select(samples: DataFrame, query: Query, text: frozenset[str] = frozenset(), rollups: DataFrame | None = None, granularity: int = 0) -> DataFrame:
    """The answer to a query: labels, lset, time (milliseconds) and its columns; for all metrics, metric and a column for each function or `value`.

    `text` names metrics whose samples are text, which raw columns then give. Rollup rows, if given, serve a query that asks for
    them and that they fit.
    """
    query = resolved(query)
    look_back = max([query.window, *(c.tolerance for c in query.columns if query.kind in ("sampled", "across", "mixed"))])
    rows = scoped(samples, query, look_back)
    if query.kind == "raw":
        if query.columns[0].wildcard:
            return rows.select("metric", "labels", "lset", F.col("t_ms").alias("time"), F.col("v").alias("value"), F.col("s").alias("text"))
        return aligned(rows, [(c.name, c.metric) for c in query.columns], text)
    if query.kind == "sampled":
        return _timed(_downsampled(rows, query, query.columns, text), query)
    if query.kind == "across":
        return _timed(_across(rows, query), query)
    with_function = [c for c in query.columns if c.function]
    if query.kind == "cells" and query.rollups and rollups is not None and rollups_fit(query, granularity, list(NEEDS)):
        condition = parse_filter(query.filter)
        own = rollups if any(c.wildcard for c in query.columns) else rollups.where(F.col("metric").isin(sorted({c.metric for c in query.columns})))
        own = _grouped(own if condition is None else own.where(condition), query.group_by)
        placed = C.rollup_window(own, granularity, query.start, query.stop, query.step, query.window) if query.window else C.rollup_interval(own, granularity, query.start, query.stop, query.step)
        return _timed(_over_cells(placed, query, with_function, rolled=True), query)
    cells = _over_cells(_cells(_grouped(rows, query.group_by), query, F.col("t_ms")), query, with_function, rolled=False)
    if query.kind == "cells":
        return _timed(cells, query)
    raw = _downsampled(rows, query, [c for c in query.columns if not c.function])
    both = merged_columns([cells.withColumnRenamed("labels", "_a"), raw.withColumnRenamed("labels", "_b")], ["lset", "k"])
    return _timed(both.withColumn("labels", F.coalesce("_a", "_b")).drop("_a", "_b"), query).select("labels", "lset", "time", *[c.name for c in query.columns])


def overlap(samples: DataFrame, query: Query, windows: list[int]) -> DataFrame:
    """Aggregates over windows that end together, `windows` steps long each, stamped with their starts."""
    query = resolved(query)
    wanted: Wanted = [(c.name, c.metric, c.base) for c in query.columns]
    longest = max(windows) * query.step
    rows = scoped(samples, query, max(0, query.start - (query.stop // query.step * query.step - longest)))
    placed = C.overlapping(_grouped(rows, query.group_by), F.col("t_ms"), query.stop, query.step, windows)
    return aggregate(placed, ["lset", "time"], wanted, query.step)


def long_form(answer: DataFrame, query: Query) -> DataFrame:
    """The answer with a row for each value: metric, labels, lset, aggregate, time, value; cells without a value are left out."""
    columns = [c for c in resolved(query).columns]
    pairs = F.array(*[F.struct(F.lit(c.alias or c.metric).alias("metric"), F.lit(c.base).alias("aggregate"), F.col(f"`{c.name}`").cast("double").alias("value")) for c in columns])
    rest = [c for c in ("labels", "lset", "time") if c in answer.columns]
    return answer.select(*rest, F.explode(pairs).alias("x")).select("x.metric", *rest, "x.aggregate", "x.value").where("value IS NOT NULL")

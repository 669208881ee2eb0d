"""The engine's queries over the driver's tables, each with the SQL that another engine answers it with.

Times are whole milliseconds; derived numbers are rounded on both sides, as sums depend on their order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.times import DAY, HOUR
from tempora.operators import metadata
from tempora.operators.aggregate import merged, over_labels, rolled_up
from tempora.plans.planner import overlap, select
from tempora.plans.spec import Column, Query
from tempora.plans.sql import parse_select
from tempora.sources.samples import from_events, from_lineitem, from_orders
from tempora.sources.table import accepted

#: 2024-01-01 and 2024-01-31 in UTC.
START, STOP = 1_704_067_200_000, 1_706_659_200_000
TYPES = ("click", "error", "purchase", "signup", "view")
PARTITION = 2 * DAY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The samples of `events`; user labels as text.
EVENTS = "SELECT event_type AS metric, 'user_id=' || user_id AS lset, CAST(user_id AS VARCHAR) AS usr, epoch_us(ts) // 1000 AS t, value AS v FROM events"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def register(name: str, oracle: str | None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


#: Digits that are kept of what may have five or more, so that no value lies half way between two.
DIGITS = {"avg": 9, "stdvar": 9, "rate": 12}


def digits(name: str) -> int:
    return DIGITS.get(name.split("(")[0], 4)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """df with some columns rounded; a count that is null where a group has no sample of the metric is 0."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits(c)).alias(c) if c in names else F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c.startswith("count(") else F.col(f"`{c}`") for c in df.columns])


def _simple(name: str, q: Query, oracle: str, drop: tuple[str, ...] = ("labels",), round_: tuple[str, ...] = (), source: Callable = events) -> None:
    @register(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(select(source(spark, sf_dir), q).drop(*drop), *round_)


def _all(functions: list[str], step: int = DAY, window: int = 0, **options: object) -> Query:
    return Query(START, STOP, [Column("*", f) for f in functions], step, window, **options)


# --- raw

_simple("raw_select", Query(START, STOP, [Column("click"), Column("view")]), f"""
SELECT lset, t AS time, min(v) FILTER (metric = 'click') AS click, min(v) FILTER (metric = 'view') AS view FROM ({EVENTS})
WHERE metric IN ('click', 'view') AND t BETWEEN {START} AND {STOP} GROUP BY lset, t""")
_simple("raw_filter_label", Query(START, STOP, [Column("*")], filter="starts(__name__, 'p') and (user_id == '7' or user_id in ('11', '13')) and not user_id == '9'"), f"""
SELECT metric, lset, t AS time, v AS value FROM ({EVENTS}) WHERE starts_with(metric, 'p') AND usr IN ('7', '11', '13')""", drop=("labels", "text"))
_simple("align_metrics", Query(START, STOP, [Column("click", alias="c"), Column("view"), Column("purchase")]), f"""
SELECT lset, t AS time, min(v) FILTER (metric = 'click') AS c, min(v) FILTER (metric = 'view') AS view, min(v) FILTER (metric = 'purchase') AS purchase
FROM ({EVENTS}) WHERE metric IN ('click', 'view', 'purchase') AND t BETWEEN {START} AND {STOP} GROUP BY lset, t""")

# --- cells

_K = f"(t - {START}) // {{0}} * {{0}} + {START} AS time"
_FUNCTIONS = {
    "count": "count(*)", "sum": "sum(v)", "sqr": "sum(v * v)", "min": "min(v)", "max": "max(v)", "avg": "sum(v) / count(*)", "last": "arg_max(v, t)",
    "stddev": "CASE WHEN count(*) > 1 THEN stddev_samp(v) END", "stdvar": "CASE WHEN count(*) > 1 THEN var_samp(v) END",
}
_IN = f"FROM ({EVENTS}) WHERE t BETWEEN {START} AND {STOP}"


def _columns(*functions: str) -> str:
    return ", ".join((f"round({_FUNCTIONS[f]}, {digits(f)})" if f not in ("count", "min", "max", "last") else _FUNCTIONS[f]) + f" AS {f}" for f in functions)


for _f in _FUNCTIONS:
    _simple(f"agg_interval_{_f}", _all([_f], 7 * DAY), f"SELECT metric, lset, {_K.format(7 * DAY)}, {_columns(_f)} {_IN} GROUP BY ALL", round_=("sum", "sqr", "avg", "stddev", "stdvar"))
_simple("agg_groupby_label", Query(START, STOP, [Column("click", "sum"), Column("click", "count"), Column("view", "avg")], 2 * DAY, group_by=["user_id"]), f"""
SELECT lset, {_K.format(2 * DAY)}, round(sum(v) FILTER (metric = 'click'), 4) AS "sum(click)", count(*) FILTER (metric = 'click') AS "count(click)", round(avg(v) FILTER (metric = 'view'), 9) AS "avg(view)"
{_IN} AND metric IN ('click', 'view') GROUP BY ALL""", round_=("sum(click)", "avg(view)"))
_simple("agg_zero_step", Query(START, STOP, [Column("click", "max"), Column("click", "min"), Column("click", "count")]), f"""
SELECT lset, {START} AS time, max(v) AS "max(click)", min(v) AS "min(click)", count(*) AS "count(click)" {_IN} AND metric = 'click' GROUP BY lset""")


@register("agg_interval", f"SELECT metric, {_K.format(DAY)}, {_columns('count', 'sum', 'avg')} {_IN} GROUP BY ALL")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum and average of each metric by day, over all series."""
    from tempora.operators.aggregate import aggregate
    from tempora.operators.cells import interval

    placed = interval(events(spark, sf_dir), F.col("t_ms"), START, STOP, DAY).drop("labels")
    out = aggregate(placed, ["metric", "k"], [(f, "", f) for f in ("count", "sum", "avg")], DAY, by_metric=False)
    return rounded(out.select("metric", (F.col("k") * DAY + START).alias("time"), "count", "sum", "avg"), "sum", "avg")


def _window_oracle(step: int, width: int) -> str:
    low = ">" if width == step else ">="
    return f"""SELECT s.metric, s.lset, g.time, count(*) AS count, round(sum(v), 4) AS sum FROM ({EVENTS}) s
JOIN (SELECT unnest(range({START}, {STOP} + 1, {step})) AS time) g ON s.t <= g.time AND s.t {low} g.time - {width} WHERE s.t <= {STOP} GROUP BY ALL"""


for _n, _w in (("gt", 5 * DAY), ("lt", DAY), ("eq", 2 * DAY)):
    _simple(f"agg_window_{_n}_step", _all(["count", "sum"], 2 * DAY, _w), _window_oracle(2 * DAY, _w), round_=("sum",))



@register("overlap_windows", f"SELECT lset, {STOP - DAY} - w.n * {HOUR} AS time, count(*) AS \"count(click)\", round(sum(v), 4) AS \"sum(click)\" FROM ({EVENTS}) s JOIN (SELECT unnest([1, 6, 24, 240]) AS n) w ON s.t > {STOP - DAY} - w.n * {HOUR} AND s.t < {STOP - DAY} WHERE s.metric = 'click' GROUP BY ALL")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(START, STOP - DAY, [Column("click", "count"), Column("click", "sum")], HOUR)
    return rounded(overlap(events(spark, sf_dir), q, [1, 6, 24, 240]).drop("labels"), "sum(click)")


_simple("rate_interval", _all(["rate"], 2 * DAY), f"""
WITH c AS (SELECT metric, lset, (t - {START}) // {2 * DAY} AS k, arg_max(v, t) AS last {_IN} GROUP BY ALL)
SELECT metric, lset, k * {2 * DAY} + {START} AS time, round(CASE WHEN lag(k) OVER w = k - 1 THEN (last - lag(last) OVER w) / {2 * DAY / 1000.0} END, 12) AS rate FROM c WINDOW w AS (PARTITION BY metric, lset ORDER BY k)""", round_=("rate",))

# --- grid sampling

_GRID_STEP, _TOLERANCE = DAY, 2 * DAY
_SAMPLED = f"""SELECT g.metric, g.lset, g.time, a.t AS t1, a.v AS v1, b.t AS t0, b.v AS v0 FROM
(SELECT * FROM (SELECT DISTINCT metric, lset FROM s), (SELECT unnest(range({START}, {STOP} + 1, {_GRID_STEP})) AS time)) g
ASOF JOIN s a ON g.metric = a.metric AND g.lset = a.lset AND g.time <= a.t
ASOF LEFT JOIN s b ON g.metric = b.metric AND g.lset = b.lset AND g.time > b.t"""
_VALUES = {
    "none": "v1",
    "next_val": f"CASE WHEN t1 - time <= {_TOLERANCE} THEN v1 END",
    "prev_val": f"CASE WHEN t1 = time THEN v1 WHEN time - t0 <= {_TOLERANCE} THEN v0 END",
    "linear": f"CASE WHEN t1 = time THEN v1 WHEN t1 - time <= {_TOLERANCE} AND time - t0 <= {_TOLERANCE} THEN v0 + (v1 - v0) * (time - t0) / (t1 - t0) END",
}


def _grid_sql(interpolator: str, back: int, where: str = "") -> str:
    return f"WITH s AS (SELECT * FROM ({EVENTS}) WHERE t BETWEEN {START - back} AND {STOP}{where}), x AS ({_SAMPLED}), y AS (SELECT metric, lset, time, {_VALUES[interpolator]} AS value FROM x) "


for _i in _VALUES:
    _simple(f"downsample_{_i.removesuffix('_val')}", Query(START, STOP, [Column("*", interpolator=_i)], _GRID_STEP), _grid_sql(_i, _TOLERANCE) + "SELECT metric, lset, time, round(value, 4) AS value FROM y WHERE value IS NOT NULL", round_=("value",))
for _f in ("sum", "min", "max", "avg", "count"):  # the others stand in catalog_more
    _simple(f"cross_series_{_f}", Query(START, STOP, [Column("*", f"{_f}_all", interpolator="prev_val")], _GRID_STEP), _grid_sql("prev_val", _TOLERANCE) + f"SELECT metric, time, round({_f}(value), {digits(_f)}) AS {_f} FROM y WHERE value IS NOT NULL GROUP BY metric, time", round_=(_f,))
_simple("cross_series_groupby", Query(START, STOP, [Column("click", "sum_all", interpolator="next_val"), Column("view", "count_all", interpolator="next_val")], _GRID_STEP, group_by=["user_id"]), _grid_sql("next_val", _TOLERANCE) + """
SELECT lset, time, round(sum(value) FILTER (metric = 'click'), 4) AS "sum(click)", count(*) FILTER (metric = 'view') AS "count(view)" FROM y WHERE value IS NOT NULL AND metric IN ('click', 'view') GROUP BY lset, time""", round_=("sum(click)",))
_simple("mixed_aggregate_raw", Query(START, STOP, [Column("click", "avg", interpolator="next_val"), Column("click", interpolator="next_val")], _GRID_STEP), _grid_sql("next_val", _TOLERANCE, " AND metric = 'click'") + f""",
a AS (SELECT lset, {_K.format(_GRID_STEP)}, round(sum(v) / count(*), 9) AS c {_IN} AND metric = 'click' GROUP BY ALL)
SELECT coalesce(a.lset, y.lset) AS lset, coalesce(a.time, y.time) AS time, a.c AS "avg(click)", round(y.value, 4) AS click FROM a FULL JOIN (SELECT * FROM y WHERE value IS NOT NULL) y ON a.lset = y.lset AND a.time = y.time""", round_=("avg(click)", "click"))

# --- rollups

_ROLLED = f"SELECT metric, lset, usr, t // {HOUR} * {HOUR} AS b, count(*) AS c, sum(v) AS s, sum(v * v) AS q, min(v) AS lo, max(v) AS hi, arg_max(v, t) AS l, max(t) AS lt FROM ({EVENTS}) GROUP BY ALL"


@register("rollup_build", f"SELECT metric, lset, b AS bucket_ms, c AS count, round(s, 4) AS sum, round(q, 4) AS sqr, lo AS min, hi AS max, l AS last, lt AS last_t FROM ({_ROLLED})")
def _rollup_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolled_up(events(spark, sf_dir), HOUR).drop("labels"), "sum", "sqr")


@register("rollup_merge", f"SELECT metric, lset, b AS bucket_ms, c AS count, round(s, 4) AS sum, round(q, 4) AS sqr, lo AS min, hi AS max, l AS last, lt AS last_t FROM ({_ROLLED})")
def _rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of two halves of the samples, made one."""
    rows = events(spark, sf_dir)
    parts = [rolled_up(rows.where(F.pmod(F.col("t_ms"), F.lit(2)) == i), HOUR) for i in (0, 1)]
    return rounded(merged(parts[0].unionByName(parts[1])).drop("labels"), "sum", "sqr")


def _rolled_query(q: Query) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir)
        return rounded(select(rows, q, rollups=rolled_up(rows, HOUR), granularity=HOUR).drop("labels"), "sum")

    return run


_MID = START + 17 * 60_000  # so that cells cut through buckets
register("rollup_served_interval", f"""SELECT metric, lset, (b + {HOUR // 2} - {_MID}) // {6 * HOUR} * {6 * HOUR} + {_MID} AS time, CAST(sum(c) AS BIGINT) AS count, round(sum(s), 4) AS sum, max(hi) AS max FROM ({_ROLLED})
WHERE b + {HOUR // 2} BETWEEN {_MID} AND {STOP + 6 * HOUR} AND (b + {HOUR // 2} - {_MID}) // {6 * HOUR} <= ({STOP} - {_MID}) // {6 * HOUR} GROUP BY ALL
""")(_rolled_query(Query(_MID, STOP, [Column("*", f) for f in ("count", "sum", "max")], 6 * HOUR, rollups=True)))
register("rollup_window", f"""SELECT metric, lset, g.time, CAST(sum(c) AS BIGINT) AS count, round(sum(s), 4) AS sum FROM ({_ROLLED}) r JOIN (SELECT unnest(range({START}, {STOP} + 1, {12 * HOUR})) AS time) g
ON b + {HOUR // 2} <= g.time AND b + {HOUR // 2} >= g.time - {18 * HOUR} WHERE b + {HOUR // 2} <= {STOP + 12 * HOUR} GROUP BY ALL
""")(_rolled_query(Query(START, STOP, [Column("*", f) for f in ("count", "sum")], 12 * HOUR, 18 * HOUR, rollups=True)))


@register("preagg_groupby", f"SELECT metric, b AS bucket_ms, CAST(sum(c) AS BIGINT) AS count, round(sum(s), 4) AS sum, min(lo) AS min, max(hi) AS max FROM ({_ROLLED}) GROUP BY metric, b")
def _preagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(over_labels(rolled_up(events(spark, sf_dir), HOUR), []).select("metric", "bucket_ms", "count", "sum", "min", "max"), "sum")


# --- metadata


@register("metric_names", "SELECT DISTINCT event_type AS metric FROM events")
def _metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.metric_names(events(spark, sf_dir))


@register("label_values", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events")
def _label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.label_values(events(spark, sf_dir), "user_id")


@register("label_names", "SELECT 'user_id' AS label")
def _label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.label_names(events(spark, sf_dir))


@register("label_sets", "SELECT DISTINCT event_type AS metric, 'user_id=' || user_id AS lset FROM events")
def _label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.label_sets(events(spark, sf_dir)).drop("labels")


@register("count_items", f"SELECT count(*) AS series FROM (SELECT DISTINCT epoch_us(ts) // 1000 // {PARTITION}, event_type, user_id FROM events)")
def _count_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.count_series(events(spark, sf_dir), PARTITION)


# --- ingest and delete

_HALF = START + 15 * DAY
_DOUBLED = f"SELECT *, t // {HOUR} * {HOUR} AS h FROM ({EVENTS})"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with times cut to the hour, so that many share one."""
    return events(spark, sf_dir).withColumn("arrival", F.col("t_ms")).withColumn("t_ms", F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(HOUR)))


@register("ingest_dedupe", f"SELECT metric, lset, h AS t_ms, arg_min(v, t) AS v FROM ({_DOUBLED}) GROUP BY metric, lset, h")
def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(_hourly(spark, sf_dir), None).select("metric", "lset", "t_ms", "v")


_LAST = f"SELECT metric, lset, max(t) AS m FROM ({EVENTS}) WHERE t < {_HALF} GROUP BY metric, lset"
_BATCH = f"(SELECT * FROM ({EVENTS}) WHERE t >= {_HALF - 3 * DAY})"


def _second_batch(spark: SparkSession, sf_dir: str, override: bool) -> DataFrame:
    rows = events(spark, sf_dir)
    last = rows.where(F.col("t_ms") < _HALF).groupBy("metric", "lset").agg(F.max("t_ms").alias("max_t"))
    return accepted(rows.where(F.col("t_ms") >= _HALF - 3 * DAY), last, override).select("metric", "lset", "t_ms", "v")


@register("late_drop", f"SELECT b.metric, b.lset, t AS t_ms, v FROM {_BATCH} b LEFT JOIN ({_LAST}) l ON b.metric = l.metric AND b.lset = l.lset WHERE m IS NULL OR t > m")
def _late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_batch(spark, sf_dir, False)


@register("late_override", f"SELECT b.metric, b.lset, t AS t_ms, v FROM {_BATCH} b LEFT JOIN ({_LAST}) l ON b.metric = l.metric AND b.lset = l.lset WHERE m IS NULL OR t > m - {59 * 60_000}")
def _late_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second_batch(spark, sf_dir, True)


def _stored(spark: SparkSession, sf_dir: str, label_sets: str = ""):  # noqa: ANN202
    """A table of events, new for each call."""
    import uuid

    from tempora.sources.files import shared_root
    from tempora.sources.schema import make_schema
    from tempora.sources.table import Table

    table = Table.create(spark, f"{shared_root(spark)}/tempora/table-{uuid.uuid4().hex}", make_schema(aggregates="*", label_sets=label_sets))
    table.files.delete_at_end()
    table.append(events(spark, sf_dir))
    return table


@register("delete_range", f"SELECT metric, lset, t AS t_ms, v FROM ({EVENTS}) WHERE NOT (t BETWEEN {START + DAY} AND {START + 5 * DAY} AND metric = 'click' AND CAST(usr AS BIGINT) < 100)")
def _delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored(spark, sf_dir)
    table.delete(START + DAY, START + 5 * DAY, ["click"], "user_id < 100")
    return table.samples().select("metric", "lset", "t_ms", "v")


@register("delete_rollup_repair", f"SELECT metric, lset, b AS bucket_ms, c AS count, round(s, 4) AS sum FROM (SELECT metric, lset, t // {HOUR} * {HOUR} AS b, count(*) AS c, sum(v) AS s FROM ({EVENTS}) WHERE NOT (t BETWEEN {START + DAY} AND {START + 5 * DAY} AND metric = 'view') GROUP BY ALL)")
def _delete_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored(spark, sf_dir)
    table.delete(START + DAY, START + 5 * DAY, ["view"])
    return rounded(table.rollups().select("metric", "lset", "bucket_ms", "count", "sum"), "sum")


@register("table_select", f"SELECT lset, {_K.format(DAY)}, round(sum(v), 4) AS \"sum(click)\" {_IN} AND metric = 'click' GROUP BY ALL")
def _table_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stored(spark, sf_dir).select(Query(START, STOP, [Column("click", "sum")], DAY), rollups=False).drop("labels"), "sum(click)")


# --- SQL and other tables


def _sql(name: str, text: str, step: int, oracle: str, round_: tuple[str, ...] = (), window: int = 0) -> None:
    columns, _, where, groups = parse_select(text)
    _simple(name, Query(START, STOP, columns, step, window, where, groups), oracle, round_=round_)


_sql("sql_aggregate", "select max(click) as top, avg(click), stddev(view) from events where user_id != '3' group by user_id", 5 * DAY, f"""
SELECT lset, {_K.format(5 * DAY)}, max(v) FILTER (metric = 'click') AS top, round(avg(v) FILTER (metric = 'click'), 9) AS "avg(click)",
CASE WHEN count(*) FILTER (metric = 'view') > 1 THEN round(stddev_samp(v) FILTER (metric = 'view'), 4) END AS "stddev(view)" {_IN} AND metric IN ('click', 'view') AND usr <> '3' GROUP BY ALL""", ("avg(click)", "stddev(view)"))
_sql("sql_interpolated", "select sum_all(prev_val(error, '1d')) as errors from events", DAY, (_grid_sql("prev_val", DAY, " AND metric = 'error'") + "SELECT time, round(sum(value), 4) AS errors FROM y WHERE value IS NOT NULL GROUP BY time").replace(f"time - t0 <= {_TOLERANCE}", f"time - t0 <= {DAY}"), ("errors",))
_sql("sql_raw", "select click from events", 0, f"SELECT lset, t AS time, v AS click {_IN} AND metric = 'click'")

_LINES = "SELECT l_returnflag AS metric, 'linestatus=' || l_linestatus AS lset, epoch_us(l_shipdate) // 1000 AS t, l_extendedprice AS v FROM lineitem"
_L0, _L1 = 694_224_000_000, 946_684_800_000  # 1992 to 2000
_simple("lineitem_daily", Query(_L0, _L1, [Column("*", f) for f in ("count", "sum", "min", "max")], DAY), f"SELECT metric, lset, (t - {_L0}) // {DAY} * {DAY} + {_L0} AS time, count(*) AS count, round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max FROM ({_LINES}) WHERE t BETWEEN {_L0} AND {_L1} GROUP BY ALL", source=lambda s, d: from_lineitem(s.read.parquet(f"{d}/lineitem.parquet")))
_lineitem = QUERIES["lineitem_daily"]
QUERIES["lineitem_daily"] = lambda spark, sf_dir: _lineitem(spark, sf_dir).withColumn("sum", F.round("sum", 2))
_ORDERS = "SELECT o_orderstatus AS metric, 'priority=' || o_orderpriority AS lset, epoch_us(o_orderdate) // 1000 AS t, o_totalprice AS v FROM orders"
_simple("orders_monthly", Query(_L0, _L1, [Column("*", f) for f in ("count", "avg")], 30 * DAY), f"SELECT metric, lset, (t - {_L0}) // {30 * DAY} * {30 * DAY} + {_L0} AS time, count(*) AS count, round(avg(v), 7) AS avg FROM ({_ORDERS}) WHERE t BETWEEN {_L0} AND {_L1} GROUP BY ALL", source=lambda s, d: from_orders(s.read.parquet(f"{d}/orders.parquet")))
_orders = QUERIES["orders_monthly"]
QUERIES["orders_monthly"] = lambda spark, sf_dir: _orders(spark, sf_dir).withColumn("avg", F.round("avg", 7))

from tempora.plans import catalog_more  # noqa: E402, F401  registers more

"""More of the engine's queries: files in and out, stored tables and what happens to them, streams, parsers and checks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.aggregates import parse_functions, parse_label_sets
from tempora.functions.interpolate import parse_interpolator
from tempora.functions.labels import labels_from_text, lset
from tempora.functions.times import DAY, HOUR, bucket_of, chunk_of, format_time, parse_duration, parse_rate, parse_time, partition_start, resolve_range
from tempora.operators.aggregate import rolled_up
from tempora.plans.catalog import _GRID_STEP, _IN, _K, _TOLERANCE, EVENTS, QUERIES, START, STOP, _all, _columns, _grid_sql, _simple, _stored, events, register, rounded
from tempora.plans.planner import long_form, select
from tempora.plans.spec import Column, Query, product, resolved
from tempora.plans.sql import parse_select
from tempora.sources import formats, samples
from tempora.sources.files import Files, shared_root
from tempora.sources.table import Table, mixed_types
from tempora.streaming.ingest import events_stream, into_table, monotonic

def folder(spark: SparkSession, name: str) -> str:
    """A new shared folder that goes when the application ends."""
    files = Files(spark, f"{shared_root(spark)}/tempora/{name}-{uuid.uuid4().hex}")
    files.delete_at_end()
    return files.root


def _schema():  # noqa: ANN202
    from tempora.sources.schema import make_schema

    return make_schema(aggregates="*")


def values(*rows: tuple) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


def told(f: Callable, *args: object, **options: object) -> str:
    """What a parser says, or that it refuses."""
    try:
        return str(f(*args, **options))
    except (ValueError, OverflowError):
        return "error"


# --- sampling and aggregates

_simple("downsample_nan", Query(START, STOP, [Column("*", interpolator="nan")], _GRID_STEP), "WITH s AS (SELECT * FROM (" + EVENTS + f") WHERE t BETWEEN {START - _TOLERANCE} AND {STOP}), " + _grid_sql("none", _TOLERANCE).split("), ", 1)[1].split(", y AS")[0] + " SELECT metric, lset, time, CASE WHEN t1 = time THEN round(v1, 4) END AS value, t1 <> time AS nothing FROM x WHERE t1 IS NOT NULL")


def _nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN as null and a flag, as engines order it differently."""
    got = select(events(spark, sf_dir), Query(START, STOP, [Column("*", interpolator="nan")], _GRID_STEP))
    return got.select("metric", "lset", "time", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"), F.isnan("value").alias("nothing"))


QUERIES["downsample_nan"] = _nan

_ACROSS = {"sqr": "round(sum(value * value), 4)", "last": "arg_max(value, lset)", "stddev": "CASE WHEN count(*) > 1 THEN round(stddev_samp(value), 4) END", "stdvar": "CASE WHEN count(*) > 1 THEN round(var_samp(value), 9) END"}
for _f, _expr in _ACROSS.items():
    _simple(f"cross_series_{_f}", Query(START, STOP, [Column("*", f"{_f}_all", interpolator="prev_val")], _GRID_STEP), _grid_sql("prev_val", _TOLERANCE) + f"SELECT metric, time, {_expr} AS {_f} FROM y WHERE value IS NOT NULL GROUP BY metric, time", round_=(_f,) if _f != "last" else ())
_simple("agg_all_primitives", _all(parse_functions("*"), 5 * DAY), f"SELECT metric, lset, {_K.format(5 * DAY)}, {_columns(*parse_functions('*'))} {_IN} GROUP BY ALL", round_=("sum", "sqr"))
_simple("product_columns", Query(START, STOP, product("click, view", "sum, count, max"), 3 * DAY), f"""
SELECT lset, {_K.format(3 * DAY)}, {', '.join(f"{'round(sum(v) FILTER (metric = ' + repr(m) + '), 4)' if f == 'sum' else ('count(*)' if f == 'count' else 'max(v)') + ' FILTER (metric = ' + repr(m) + ')'} AS {chr(34)}{f}({m}){chr(34)}" for m in ('click', 'view') for f in ('sum', 'count', 'max'))}
{_IN} AND metric IN ('click', 'view') GROUP BY ALL""", round_=("sum(click)", "sum(view)"))


@register("long_form", f"""
SELECT metric, lset, time, aggregate, value FROM (SELECT metric, lset, {_K.format(4 * DAY)}, round(sum(v), 4) AS s, max(v) AS m, round(stddev_samp(v), 4) AS d, count(*) AS n {_IN} AND metric IN ('click', 'error') GROUP BY ALL),
LATERAL (VALUES ('sum', s), ('max', m), ('stddev', CASE WHEN n > 1 THEN d END)) x(aggregate, value) WHERE value IS NOT NULL""")
def _long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each value with its function; cells without a value are left out."""
    q = Query(START, STOP, [Column(m, f) for m in ("click", "error") for f in ("sum", "max", "stddev")], 4 * DAY)
    got = long_form(select(events(spark, sf_dir), q), q)
    return got.select("metric", "lset", "time", "aggregate", F.when(F.col("aggregate") == "max", F.col("value")).otherwise(F.round("value", 4)).alias("value"))


@register("nan_compatible", f"""
SELECT lset, time, coalesce(c, 'nan'::DOUBLE) = 'nan'::DOUBLE AS c_is_nan, coalesce(round(c, 4), 0) AS c FROM (SELECT lset, {_K.format(2 * DAY)}, sum(v) FILTER (metric = 'click') AS c {_IN} AND metric IN ('click', 'view') GROUP BY ALL)""")
def _nan_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query(START, STOP, [Column("click", "sum", alias="c"), Column("view", "sum", alias="w")], 2 * DAY)
    got = formats.nan_compatible(select(events(spark, sf_dir), q).drop("labels"))
    return got.select("lset", "time", F.isnan("c").alias("c_is_nan"), F.when(F.isnan("c"), 0.0).otherwise(F.round("c", 4)).alias("c"))


_NUMBERS = "SELECT 'line' AS metric, CAST(l_linenumber AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'order', CAST(o_orderkey AS DOUBLE) FROM orders UNION ALL SELECT 'price', CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) FROM orders UNION ALL SELECT 'nation', CAST(c_nationkey AS DOUBLE) FROM customer"


@register("numeric_types", f"SELECT metric, count(*) AS count, round(sum(v), 2) AS sum, min(v) AS min, max(v) AS max FROM ({_NUMBERS}) GROUP BY metric")
def _numeric_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers, decimals and doubles as samples."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none = F.create_map().cast("map<string,string>")
    parts = [("lineitem", "line", F.col("l_linenumber")), ("orders", "order", F.col("o_orderkey")), ("orders", "price", F.col("o_totalprice").cast("decimal(18,2)")), ("customer", "nation", F.col("c_nationkey"))]
    frames = [samples.canonical(read(t), F.lit(m), none, F.lit(START), v) for t, m, v in parts]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    q = Query(START, START + DAY, [Column("*", f) for f in ("count", "sum", "min", "max")], DAY)
    return select(rows, q).select("metric", "count", F.round("sum", 2).alias("sum"), "min", "max")


_ODD = "CASE WHEN usr::BIGINT % 7 = 0 THEN 'nan'::DOUBLE WHEN usr::BIGINT % 11 = 0 THEN 'inf'::DOUBLE ELSE v END"


@register("rollup_finite", f"SELECT metric, lset, t // {HOUR} * {HOUR} AS bucket_ms, count(*) AS count, round(coalesce(sum(x) FILTER (isfinite(x)), 0), 4) AS sum, round(coalesce(sum(x * x) FILTER (isfinite(x)), 0), 4) AS sqr FROM (SELECT *, {_ODD} AS x FROM ({EVENTS})) GROUP BY ALL")
def _rollup_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that aren't finite count but stay out of the sums."""
    user = F.col("labels")["user_id"].cast("long")
    rows = events(spark, sf_dir).withColumn("v", F.when(user % 7 == 0, float("nan")).when(user % 11 == 0, float("inf")).otherwise(F.col("v")))
    return rounded(rolled_up(rows, HOUR).select("metric", "lset", "bucket_ms", "count", "sum", "sqr"), "sum", "sqr")


_simple("filter_exists", Query(START, STOP, [Column("*", "count")], 10 * DAY, filter="exists(user_id) and not exists(host) and (user_id < 10 or not user_id >= 20) and __name__ != 'view'"), f"SELECT metric, lset, {_K.format(10 * DAY)}, count(*) AS count {_IN} AND (usr::BIGINT < 10 OR NOT usr::BIGINT >= 20) AND metric <> 'view' GROUP BY ALL")

# --- files in and out


@register("csv_ingest", "SELECT metric, lset, t AS t_ms, v FROM (" + EVENTS + ")")
def _csv_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, written as lines of metric, labels, value and time, and read."""
    path = folder(spark, "csv")
    events(spark, sf_dir).select("metric", "lset", F.col("v").cast("string"), F.col("t_ms").cast("string")).write.csv(path, quoteAll=True)
    return samples.read_csv(spark, path).select("metric", "lset", "t_ms", "v")


@register("json_ingest", "SELECT metric, lset, t AS t_ms, v FROM (" + EVENTS + ")")
def _json_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, written as one JSON object for each series and day, and read."""
    path = folder(spark, "json")
    points = F.collect_list(F.struct(F.col("t_ms").cast("string").alias("t"), F.struct(F.col("v").alias("n")).alias("v"))).alias("samples")
    rows = events(spark, sf_dir).groupBy("metric", "lset", (F.col("t_ms") - F.pmod("t_ms", F.lit(DAY))).alias("day")).agg(F.any_value("labels").alias("labels"), points)
    rows.select(F.to_json(F.struct("metric", "labels", "samples"))).write.text(path)
    return samples.read_json(spark, path).select("metric", "lset", "t_ms", "v")


@register("inline_ingest", f"SELECT * FROM (VALUES ('cpu', 'os=mac', {START}, 1.5::DOUBLE, NULL), ('cpu', 'os=mac', {START + 1000}, -2.0, NULL), ('state', '', {START}, NULL, 'up')) x(metric, lset, t_ms, v, s)")
def _inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpu = samples.from_arrays(spark, "cpu", "os=mac", "1.5, -2", f"{START}, {START + 1000}")
    return cpu.unionByName(samples.from_arrays(spark, "state", "", "up", str(START))).drop("labels")


_WEEKLY = Query(START, STOP, [Column("click", "sum", alias="clicks"), Column("view", "count")], 7 * DAY, group_by=[])
_SERIES = f"""SELECT metric, lset, time, aggregate, value FROM (SELECT lset, {_K.format(7 * DAY)}, sum(v) FILTER (metric = 'click') AS a, CAST(count(*) FILTER (metric = 'view') AS DOUBLE) AS b {_IN} AND metric IN ('click', 'view') GROUP BY ALL),
LATERAL (VALUES ('clicks', 'sum', a), ('view', 'count', CASE WHEN b > 0 THEN b END)) x(metric, aggregate, value) WHERE value IS NOT NULL"""
_OWN = "'Aggregate=' || aggregate || ',' || lset"
_STAMP = "strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S') || 'Z'"


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(select(events(spark, sf_dir), _WEEKLY), _WEEKLY)


def _lines(spark: SparkSession, sf_dir: str, format_: str) -> DataFrame:
    """Lines of a format; what makes them takes a partition at a time."""
    return spark.createDataFrame([(x,) for x in formats.lines(_weekly(spark, sf_dir), format_)], "line string")


@register("text_output", f"""WITH s AS ({_SERIES}) SELECT 'Name: ' || metric || '  Labels: ' || {_OWN} AS line FROM s GROUP BY metric, lset, aggregate
UNION ALL SELECT '  ' || {_STAMP} || '  v=' || format('{{:.2f}}', value) FROM s UNION ALL SELECT '' FROM (SELECT DISTINCT metric, lset, aggregate FROM s)""")
def _text_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "text")


@register("csv_output", f"""WITH s AS ({_SERIES}) SELECT metric || ',"' || {_OWN} || '",' || format('{{:.6f}}', value) || ',' || time AS line FROM s""")
def _csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "csv")


@register("json_output", f"WITH s AS ({_SERIES}) SELECT metric || '{{' || {_OWN} || '}}' AS target, count(*) AS points, round(sum(value), 4) AS total, min(time) AS first_time FROM s GROUP BY metric, lset, aggregate")
def _json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON array, read again."""
    text = spark.createDataFrame([("".join(formats.lines(_weekly(spark, sf_dir), "json")),)], "json string")
    one = text.select(F.explode(F.from_json("json", "array<struct<target:string,datapoints:array<array<double>>>>")).alias("x")).select("x.target", F.explode("x.datapoints").alias("p"))
    return one.groupBy("target").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum(F.col("p")[0]), 4).alias("total"), F.min(F.col("p")[1]).cast("long").alias("first_time"))


@register("no_output", f"WITH s AS ({_SERIES}) SELECT count(DISTINCT lset) || ' label sets' AS line FROM s")
def _no_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "none")


@register("json_query", f"WITH s AS (SELECT lset, {_K.format(7 * DAY)}, round(avg(v), 9) AS value {_IN} AND metric = 'click' GROUP BY ALL) SELECT 'click{{Aggregate=avg,' || lset || '}}' AS target, time, value FROM s")
def _json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tempora.cli import query_json

    table = _stored(spark, sf_dir)
    got = query_json(table, {"metric": "click", "aggregators": ["avg"], "step": "7d", "start_time": str(START), "end_time": str(STOP)})
    rows = [(x["target"], int(t), v) for x in got for v, t in x["datapoints"]]
    return spark.createDataFrame(rows, "target string, time long, value double").withColumn("value", F.round("value", 9))


# --- stored tables


@register("table_open", f"SELECT metric, count(*) AS count, round(sum(v), 4) AS sum, min(t) AS first_t, max(t) AS last_t FROM ({EVENTS}) GROUP BY metric")
def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a table that is opened again."""
    table = Table.open(spark, _stored(spark, sf_dir).path)
    return table.samples().groupBy("metric").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("v"), 4).alias("sum"), F.min("t_ms").alias("first_t"), F.max("t_ms").alias("last_t"))


def _appended(spark: SparkSession, sf_dir: str) -> Table:
    """A table of events that came in three batches, the second one twice and once after a failure in its middle."""
    table = Table.create(spark, folder(spark, "table"), _schema())
    rows, third = events(spark, sf_dir), (STOP - START) // 3
    for i in range(3):
        batch = rows.where(F.col("t_ms").between(START + i * third, START + (i + 1) * third - 1))
        if i == 1:
            write = table._write

            def failing(kind: str, *args: object, write: Callable = write, **options: object) -> None:
                if kind == "rollup":
                    raise OSError("as if the writer had gone")
                write(kind, *args, **options)

            table._write = failing
            with contextlib.suppress(OSError):
                table.append(batch)
            table._write = write
            table.append(batch)
        table.append(batch)
    return table


_THIRDS = f"SELECT * FROM ({EVENTS}) WHERE t < {START + (STOP - START) // 3 * 3}"


@register("append_retry", f"SELECT metric, lset, t AS t_ms, v FROM ({_THIRDS})")
def _append_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir).samples().select("metric", "lset", "t_ms", "v")


@register("append_retry_rollups", f"SELECT metric, lset, t // {HOUR} * {HOUR} AS bucket_ms, count(*) AS count, round(sum(v), 4) AS sum, arg_max(v, t) AS last FROM ({_THIRDS}) GROUP BY ALL")
def _append_retry_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_appended(spark, sf_dir).rollups().select("metric", "lset", "bucket_ms", "count", "sum", "last"), "sum")


@register("table_compacted", f"SELECT metric, lset, count(*) AS samples, max(t) AS max_t, true AS numeric FROM ({_THIRDS}) GROUP BY ALL")
def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of a table whose pieces are made one."""
    table = _appended(spark, sf_dir)
    table.compact()
    table.vacuum()
    return table.series().drop("labels")


@register("table_partitions", f"SELECT t // {DAY} * {DAY} AS day, count(*) AS samples FROM ({EVENTS}) GROUP BY 1")
def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by day, read partition by partition: each registered partition has those from its start to its end."""
    table = _stored(spark, sf_dir)
    length = table.schema.partition_ms
    frames = [table.samples(p, p + length - 1) for p in table.partitions()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy((F.col("t_ms") - F.pmod("t_ms", F.lit(DAY))).alias("day")).agg(F.count(F.lit(1)).alias("samples"))


_SIX_HOURLY = f"SELECT metric, lset, {_K.format(6 * HOUR)}, count(*) AS count, round(sum(v), 4) AS sum, max(v) AS max FROM ({EVENTS}) WHERE t BETWEEN {START} AND {STOP - 1} GROUP BY ALL"


@register("table_rollup_select", _SIX_HOURLY)
def _rollup_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that the table answers from rollups by itself, as its cells are whole buckets: the samples are gone by then."""
    table = _stored(spark, sf_dir)
    q = Query(START, STOP - 1, [Column("*", f) for f in ("count", "sum", "max")], 6 * HOUR)
    table.samples = lambda start=None, stop=None: spark.createDataFrame([], samples.SCHEMA + ", part_start long")
    return rounded(table.select(q, clamp=False).drop("labels"), "sum")


@register("table_preagg_select", f"SELECT lset, {_K.format(6 * HOUR)}, count(*) FILTER (metric = 'click') AS \"count(click)\", round(sum(v) FILTER (metric = 'view'), 4) AS \"sum(view)\" FROM ({EVENTS}) WHERE t BETWEEN {START} AND {STOP - 1} AND metric IN ('click', 'view') GROUP BY ALL")
def _preagg_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouping that a label set of the table has exactly: the table answers it from the pre-aggregates, with samples and rollups gone."""
    table = _stored(spark, sf_dir, "user_id")
    q = Query(START, STOP - 1, [Column("click", "count"), Column("view", "sum")], 6 * HOUR, group_by=["user_id"])
    read = table._read
    table._read = lambda kind, schema, *args, **options: spark.createDataFrame([], schema) if kind in ("samples", "rollup") else read(kind, schema, *args, **options)
    return rounded(table.select(q, clamp=False).drop("labels"), "sum(view)")


@register("prometheus_select", f"SELECT 'click' AS metric, lset, {_K.format(HOUR)}, round(sum(v), 4) AS value {_IN} AND metric = 'click' GROUP BY ALL")
def _prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prometheus mode: a day's step becomes a rollup bucket, and no name of the aggregate."""
    got = _stored(spark, sf_dir).select_prometheus(Query(START, STOP, [Column("click", "sum")], DAY))
    return got.select("metric", "lset", "time", F.round("value", 4).alias("value"))


@register("prometheus_raw", f"SELECT 'click' AS metric, lset, t AS time, v AS value {_IN} AND metric = 'click'")
def _prometheus_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _stored(spark, sf_dir).select_prometheus(Query(START, STOP, [Column("click", "sum")], DAY), aggregates=False)
    return got.select("metric", "lset", "time", "value")


@register("names_registered", f"SELECT DISTINCT metric, lset, t // {2 * DAY} * 0 AS zero FROM ({EVENTS})")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and label sets from the table's series, without its samples."""
    table = _stored(spark, sf_dir)
    return table.label_sets().join(table.metric_names(), "metric").select("metric", "lset", F.lit(0).cast("long").alias("zero"))


@register("series_inspection", f"SELECT p AS part_start, (t - p) // c + 1 AS chunk, count(*) AS samples, min(t) AS first_t, max(t) AS last_t FROM (SELECT t, t // plen * plen AS p, c FROM ({EVENTS}), (SELECT PLEN AS plen, CLEN AS c) WHERE metric = 'click' AND usr = (SELECT min(CAST(user_id AS BIGINT))::VARCHAR FROM events WHERE event_type = 'click')) GROUP BY ALL".replace("PLEN", str(_schema().partition_ms)).replace("CLEN", str(_schema().chunk_ms)))
def _inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'").agg(F.min("user_id")).first()[0]
    return _stored(spark, sf_dir).inspect("click", {"user_id": str(first)})


@register("table_info", f"SELECT count(DISTINCT t // {_schema().partition_ms}) AS partitions, count(DISTINCT metric) AS metrics, count(DISTINCT (t // {_schema().partition_ms}, metric, lset)) AS series FROM ({EVENTS})")
def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _stored(spark, sf_dir).describe(names=True, count=True)
    return spark.createDataFrame([(len(info["partitions"]), len(info["metrics"]), info["series"])], "partitions long, metrics long, series long")


# --- deleting

_P = _schema().partition_ms
_P0 = START // _P * _P


@register("delete_partitions", f"SELECT metric, lset, t AS t_ms, v FROM ({EVENTS}) WHERE t // {_P} * {_P} > {_P0 + _P}")
def _delete_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two partitions go whole."""
    table = _stored(spark, sf_dir)
    table.delete(0, _P0 + 2 * _P - 1)
    return table.samples().select("metric", "lset", "t_ms", "v")


@register("delete_metrics", f"SELECT metric, lset, max(t) AS max_t, count(*) AS samples FROM ({EVENTS}) WHERE metric NOT IN ('click', 'error') GROUP BY ALL")
def _delete_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored(spark, sf_dir)
    table.delete(0, STOP + 10 * _P, ["click", "error"])
    return table.series().select("metric", "lset", "max_t", "samples")


@register("delete_tail", f"SELECT metric, lset, max(t) AS max_t, count(*) AS samples FROM ({EVENTS}) WHERE t < {STOP - 10 * DAY} OR t > {STOP} GROUP BY ALL")
def _delete_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last time of a series follows from what is left."""
    table = _stored(spark, sf_dir)
    table.delete(STOP - 10 * DAY, STOP)
    return table.series().select("metric", "lset", "max_t", "samples")


@register("delete_then_append", "SELECT metric, lset, t AS t_ms, v FROM (" + EVENTS + ")")
def _delete_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was deleted at the end can be added again."""
    table = _stored(spark, sf_dir)
    table.delete(STOP - 10 * DAY, STOP)
    table.append(events(spark, sf_dir))
    return table.samples().select("metric", "lset", "t_ms", "v")


@register("delete_all", "SELECT 0::BIGINT AS samples, false AS is_there")
def _delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored(spark, sf_dir)
    table.delete_all()
    again = Table.create(spark, table.path, _schema())
    n = again.samples().count()
    again.delete_all()
    return spark.createDataFrame([(n, table.files.exists("_schema.json"))], "samples long, is_there boolean")


# --- streams

#: Events of a file that a stream reads, about.
ROWS_AN_EVENT_FILE = 250_000


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of a folder, in order of time, and the stream of their samples, a third of the time a batch.

    Each third has as many files, so that a batch is what maxFilesPerTrigger says; each gets rows for all its files, as the
    least third has many times more of them than files and they are dealt in turn.
    """
    path = folder(spark, "stream")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    third, t = (STOP - START) // 3, F.unix_millis(F.col("ts").cast("timestamp"))
    inside = [(t >= START + i * third if i else F.lit(True)) & (t < START + (i + 1) * third if i < 2 else F.lit(True)) for i in range(3)]
    files = max(1, min(rows.agg(*[F.count_if(x) for x in inside]).first()) // ROWS_AN_EVENT_FILE)
    for x in inside:
        part = rows.where(x)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return samples.from_events(events_stream(spark, path, rows.schema, maxFilesPerTrigger=str(files)))


@register("stream_ingest", "SELECT metric, lset, t AS t_ms, v FROM (" + EVENTS + ")")
def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches into a table, and the same stream once more from the start, which adds nothing."""
    table, stream = Table.create(spark, folder(spark, "table"), _schema()), _event_files(spark, sf_dir)
    for _ in range(2):
        into_table(stream, table, folder(spark, "checkpoint")).awaitTermination()
    return table.samples().select("metric", "lset", "t_ms", "v")


@register("stream_monotonic", f"SELECT metric, lset, t AS t_ms, v FROM ({EVENTS})")
def _stream_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last-time rule with state for each series."""
    out = folder(spark, "monotonic")
    monotonic(_event_files(spark, sf_dir)).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(samples.SCHEMA).parquet(out).select("metric", "lset", "t_ms", "v")


# --- checks and parsers


@register("mixed_series", f"SELECT DISTINCT metric, lset FROM ({EVENTS}) WHERE usr::BIGINT % 5 = 0 AND metric = 'view'")
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that hold numbers and would get text."""
    rows = events(spark, sf_dir)
    text = rows.where((F.col("labels")["user_id"].cast("long") % 5 == 0) & (F.col("metric") == "view")).withColumn("v", F.lit(None).cast("double")).withColumn("s", F.lit("x"))
    known = rows.groupBy("metric", "lset").agg(F.any_value(F.col("v").isNotNull()).alias("numeric"))
    return mixed_types(text, known)


@register("sample_faults", f"SELECT reason, count(*) AS n FROM (SELECT CASE usr::BIGINT % 4 WHEN 0 THEN 'bad metric name' WHEN 1 THEN 'time out of range' WHEN 2 THEN 'no value, or two' END AS reason FROM ({EVENTS})) WHERE reason IS NOT NULL GROUP BY reason")
def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = events(spark, sf_dir), F.col("labels")["user_id"].cast("long") % 4
    rows = rows.withColumn("metric", F.when(kind == 0, F.concat(F.lit("1-"), "metric")).otherwise(F.col("metric"))).withColumn("t_ms", F.when(kind == 1, F.lit(-1).cast("long")).otherwise(F.col("t_ms"))).withColumn("s", F.when(kind == 2, "two"))
    return samples.faults(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("label_text", f"SELECT DISTINCT lset AS given, 'user_id=' || usr AS lset FROM ({EVENTS})")
def _label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label text to a map and back."""
    return events(spark, sf_dir).select("lset").distinct().select(F.col("lset").alias("given"), lset(labels_from_text(F.concat(F.lit(" "), "lset", F.lit(" ,")))).alias("lset"))


@register("time_arithmetic", f"SELECT t, t // {_P} * {_P} AS part_start, (t - t // {_P} * {_P}) // {_schema().chunk_ms} + 1 AS chunk, (t - t // {_P} * {_P}) // {HOUR} AS bucket FROM (SELECT min(t) AS t FROM ({EVENTS}) GROUP BY lset)")
def _arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r[0] for r in events(spark, sf_dir).groupBy("lset").agg(F.min("t_ms")).select("min(t_ms)").toLocalIterator()]
    made = [(t, (p := partition_start(t, _P)), chunk_of(t, p, _schema().chunk_ms), bucket_of(t - p, HOUR) if bucket_of(HOUR, HOUR) == 1 else bucket_of(t - p, HOUR) // HOUR) for t in rows]
    return spark.createDataFrame(made, "t long, part_start long, chunk long, bucket long")


def _parsed(name: str, f: Callable, *cases: tuple[tuple, str]) -> None:
    """A query that parses some texts on the driver, against what they mean."""

    @register(name, f"SELECT * FROM (VALUES {values(*((str(c[0]), want) for c, want in cases))}) x(given, got)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(str(c[0]), told(f, *c)) for c, _ in cases], "given string, got string")


_parsed("parse_durations", parse_duration, (("90s",), "90000"), (("5m",), "300000"), (("2h",), "7200000"), (("3d",), "259200000"), (("x",), "error"), (("7y",), "error"))
_parsed("parse_times", parse_time, (("now", 1000), "1000"), (("now-1h", HOUR * 5), str(HOUR * 4)), (("now+2m", 0), "120000"), (("1700000000000",), "1700000000000"), (("2024-01-01T00:00:00Z",), str(START)), (("never",), "error"))
_parsed("format_times", lambda t: format_time(int(t)), ((START,), "2024-01-01T00:00:00Z"), ((0,), "1970-01-01T00:00:00Z"))
_parsed("time_ranges", lambda start, stop, last: resolve_range(start, stop, last, "", 10 * DAY)[:2], (("", "", ""), str((10 * DAY - HOUR, 10 * DAY))), (("now-2d", "now-1d", ""), str((8 * DAY, 9 * DAY))))
_parsed("parse_rates", parse_rate, (("1/s",), "3600"), (("2/m",), "120"), (("5/h",), "5"), (("x/s",), "error"), (("1/d",), "error"))
_parsed("function_lists", parse_functions, (("sum, avg,,",), "['sum', 'avg']"), (("*",), "['count', 'sum', 'sqr', 'max', 'min', 'last']"), (("sum,median",), "error"))
_parsed("label_set_lists", parse_label_sets, (("b,a;c",), "[['a', 'b'], ['c']]"), (("",), "[]"))
_parsed("interpolators", parse_interpolator, (("Next",), "next_val"), (("LIN",), "linear"), (("prev_val",), "prev_val"), (("",), "none"), (("cubic",), "error"))
_parsed("sql_statements", lambda text: [(c.name, c.interpolator) for c in parse_select(text)[0]] + [parse_select(text)[1]],
        (("select click, sum(view) as v from dual",), "[('click', ''), ('v', ''), '']"), (("select max(next(click))",), "[('max(click)', 'next_val'), '']"),
        (("select click from a union select view from b",), "error"), (("select click from (select view from b)",), "error"), (("select click from a order by time",), "error"),
        (("select distinct click from a",), "error"), (("select click from a limit 5",), "error"), (("select sum(a), sum(a) from t",), "error"), (("select a as b, b from t",), "error"), (("delete from t",), "error"))


def _checked(stop: int, columns: list[Column], step: int = 0) -> str:
    q = resolved(Query(START, stop, columns, step))
    return f"{q.kind}, step {q.step}, {', '.join(f'{c.name} {c.interpolator} {c.tolerance}' for c in q.columns)}"


_CHECKS = [
    ("range", START - 1, [Column("a")], 0, "error"),
    ("twice", STOP, [Column("a", "sum"), Column("a", "sum")], DAY, "error"),
    ("interpolators", STOP, [Column("a", interpolator="next_val"), Column("a", alias="b", interpolator="linear")], DAY, "error"),
    ("tolerances", STOP, [Column("a", tolerance=1), Column("a", alias="b", tolerance=2)], DAY, "error"),
    ("across", STOP, [Column("a", "sum_all"), Column("a", "max")], DAY, "error"),
    ("rate across", STOP, [Column("a", "rate_all")], DAY, "error"),
    ("all and one", STOP, [Column("*", "sum"), Column("a", "sum")], DAY, "error"),
    ("first holds", STOP, [Column("a", interpolator="linear", tolerance=5), Column("a", alias="b")], DAY, f"sampled, step {DAY}, a linear 5, b linear 5"),
    ("whole range", START + 10, [Column("a", "sum")], 0, "cells, step 10, sum(a) none 0"),
    ("two steps", STOP, [Column("a", "sum"), Column("b")], DAY, f"mixed, step {DAY}, sum(a) none {2 * DAY}, b none {2 * DAY}"),
]


@register("query_checks", f"SELECT * FROM (VALUES {values(*((c[0], c[4]) for c in _CHECKS))}) x(given, got)")
def _query_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c[0], told(_checked, c[1], c[2], c[3])) for c in _CHECKS], "given string, got string")


_simple("duplicate_times", Query(START, STOP, [Column("click"), Column("view")]), f"SELECT lset, h AS time, min(v) FILTER (metric = 'click') AS click, min(v) FILTER (metric = 'view') AS view FROM (SELECT *, t // {DAY} * {DAY} AS h FROM ({EVENTS})) WHERE metric IN ('click', 'view') AND h BETWEEN {START} AND {STOP} GROUP BY lset, h", source=lambda s, d: events(s, d).withColumn("t_ms", F.col("t_ms") - F.pmod("t_ms", F.lit(DAY))))


@register("ordered_answer", f"SELECT row_number() OVER (ORDER BY lset, time) AS place, lset, time, count FROM (SELECT lset, {_K.format(5 * DAY)}, count(*) AS count {_IN} AND metric = 'click' GROUP BY ALL)")
def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are ordered where they are shown; the place follows from the order of rows."""
    q = Query(START, STOP, [Column("click", "count", alias="count")], 5 * DAY)
    ordered = select(events(spark, sf_dir), q).select("lset", "time", "count").orderBy("lset", "time")
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("lset", "time")).cast("long"))


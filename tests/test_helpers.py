import math

import pytest

from tempora.functions import aggregates, interpolate, labels, times
from tempora.plans.filters import parse_filter
from tempora.plans.spec import Column, Query, product, resolved
from tempora.plans.sql import parse_select
from tempora.sources.schema import check_granularity, make_schema


@pytest.mark.parametrize(("text", "ms"), [("1h", 3_600_000), ("5m", 300_000), ("0d", 0), ("6s", 6000), ("", 0), ("2", 7_200_000), ("3d", 259_200_000)])
def test_durations(text, ms):
    assert times.parse_duration(text) == ms


@pytest.mark.parametrize("text", ["-3m", "garbage", "5x", "1h2m"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        times.parse_duration(text)


def test_times():
    assert times.parse_time("now", 1000) == 1000
    assert times.parse_time("now-1m", 100_000) == 40_000
    assert times.parse_time("now+1m", 0) == 60_000
    assert times.parse_time("1532209200000") == 1_532_209_200_000
    assert times.parse_time("2018-07-21T21:40:00Z") == 1_532_209_200_000
    assert times.parse_time("2018-07-21T23:40:00+02:00") == 1_532_209_200_000
    assert times.format_time(1_532_209_200_000) == "2018-07-21T21:40:00Z"
    for bad in ("yesterday", "2018-07-21T21:40:00"):
        with pytest.raises(ValueError):
            times.parse_time(bad)


def test_range():
    now = 10 * times.HOUR
    assert times.resolve_range(now=now) == (9 * times.HOUR, now, 0)
    assert times.resolve_range("0", "now", "2h", "5m", now) == (8 * times.HOUR, now, 300_000)
    assert times.resolve_range("1000", "2000", now=now) == (1000, 2000, 0)


@pytest.mark.parametrize(("text", "n"), [("1/s", 3600), ("12/m", 720), ("2/h", 2)])
def test_rates(text, n):
    assert times.parse_rate(text) == n


@pytest.mark.parametrize("text", ["1", "1/d", "x/s", "", "0/s", "-1/s"])
def test_bad_rates(text):
    with pytest.raises(ValueError):
        times.parse_rate(text)


def test_partitions_and_chunks():
    day = times.DAY
    assert list(times.partition_range(day + 1, 3 * day, 2 * day)) == [0, 2 * day]
    assert list(times.partition_range(2 * day, 2 * day, 2 * day)) == [2 * day]
    assert times.chunk_of(2 * day, 2 * day, times.HOUR) == 1
    assert times.chunk_of(2 * day + 90 * times.MINUTE, 2 * day, times.HOUR) == 2
    assert times.bucket_of(3_599_999, times.HOUR) == 0
    assert times.cells(0, 10, 3) == 4


def test_labels():
    assert labels.parse_labels("os=linux,dc=7") == {"dc": "7", "os": "linux"}
    assert labels.format_labels({"os": "linux", "dc": "7"}) == "dc=7,os=linux"
    assert labels.filter_labels({"a": "1", "b": "2"}, ["b", "c"]) == {"b": "2"}
    assert labels.compare_labels({"a": "1"}, {"a": "2"}) == -1
    for bad in ("a", "a=b=c", "a-b=c", "a=1,a=2"):
        with pytest.raises(ValueError):
            labels.parse_labels(bad)
    for good in ("cpu", "_x:y9"):
        assert labels.check_metric(good) == good
    for bad in ("cpu-1", "9a", "", "a b"):
        with pytest.raises(ValueError):
            labels.check_metric(bad)
    with pytest.raises(ValueError):
        labels.check_label("a:b")


def test_aggregate_lists():
    assert aggregates.parse_functions(" count, ,avg") == ["count", "avg"]
    assert aggregates.parse_functions("*") == list(aggregates.PRIMITIVES)
    assert aggregates.stored(["avg"]) == ["count", "sum"]
    assert aggregates.parse_label_sets("b,a; c") == [["a", "b"], ["c"]]
    assert aggregates.split_function("sum_all") == ("sum", True)
    with pytest.raises(ValueError):
        aggregates.parse_functions("median")


@pytest.mark.parametrize(("name", "expected"), [("none", (110, 200.0)), ("prev_val", (60, 100.0)), ("next_val", (60, 200.0)), ("linear", (60, 150.0))])
def test_interpolators(name, expected):
    assert interpolate.interpolate(interpolate.parse_interpolator(name.upper()), 60, 10, 100.0, 110, 200.0, 1000) == expected


def test_interpolator_edges():
    assert math.isnan(interpolate.interpolate("nan", 60, 10, 1.0, 110, 2.0, 0)[1])
    assert math.isnan(interpolate.interpolate("linear", 60, 10, float("nan"), 110, 2.0, 1000)[1])
    assert interpolate.interpolate("prev_val", 60, 10, 1.0, 110, 2.0, 49) is None
    assert interpolate.interpolate("next_val", 60, 10, 1.0, 110, 2.0, 49) is None
    with pytest.raises(ValueError):
        interpolate.parse_interpolator("cubic")


@pytest.mark.parametrize(
    ("text", "columns", "table", "where", "groups"),
    [
        ("select columnA", [("columnA", "", "", "")], "", "", []),
        ("SELECT a, b FROM t", [("a", "", "", ""), ("b", "", "", "")], "t", "", []),
        ("select linear(a) from t", [("a", "", "", "linear")], "t", "", []),
        ("select max(prev_val(a)), avg(b) from t", [("a", "max", "", "prev_val"), ("b", "avg", "", "")], "t", "", []),
        ("select max(a) as top from t where x = 'a, from b' and y < 3 group by os, dc", [("a", "max", "top", "")], "t", "x = 'a, from b' and y < 3", ["os", "dc"]),
        ("select * from t", [("*", "", "", "")], "t", "", []),
        ("select max(*), min(*)", [("*", "max", "", ""), ("*", "min", "", "")], "", "", []),
        ("select count_all(a) from dual", [("a", "count_all", "", "")], "", "", []),
    ],
)
def test_sql(text, columns, table, where, groups):
    got, t, w, g = parse_select(text)
    assert [(c.metric, c.function, c.alias, c.interpolator) for c in got] == columns
    assert (t, w, g) == (table, where, groups)


def test_sql_tolerance():
    assert parse_select("select avg(next_val(a, '5m')) from t")[0][0].tolerance == 300_000


@pytest.mark.parametrize("text", ["select max(*) as a", "select a as x, b as x", "select a, b as a", "delete from t", "select a from t, u", "select a from (select b)", "select a from t order by a", "select a from t limit 3", "select median(a)", "select a from t union select b", "select max(a", "select distinct a", ""])
def test_bad_sql(text):
    with pytest.raises(ValueError):
        parse_select(text)


def test_names_and_checks():
    assert [c.name for c in product("a, b", "avg,max")] == ["avg(a)", "max(a)", "avg(b)", "max(b)"]
    assert Column("a", "sum_all").name == "sum(a)"
    assert Column("a", "sum", "x").name == "x"
    with pytest.raises(ValueError):
        product("a", "avg, avg")
    ok = resolved(Query(0, 100, [Column("a", "avg"), Column("a", "max", interpolator="linear")], 10))
    assert {c.interpolator for c in ok.columns} == {"linear"} and ok.columns[0].tolerance == 20
    assert resolved(Query(0, 100, [Column("a", "avg")])).step == 100
    for bad in (
        Query(10, 0, [Column("a")]),
        Query(0, 0, [Column("a", "sum")]),
        Query(0, 9, [Column("a", "sum"), Column("a", "max_all")], 1),
        Query(0, 9, [Column("a", interpolator="linear"), Column("a", "max", interpolator="nan")], 1),
        Query(0, 9, [Column("a", tolerance=1), Column("a", "max", tolerance=2)], 1),
        Query(0, 9, [Column("*", "max", "x")], 1),
        Query(0, 9, [Column("a"), Column("a")], 1),
        Query(0, 9, [], 1),
        Query(0, 9, [Column("a", "median")], 1),
    ):
        with pytest.raises(ValueError):
            resolved(bad)


def test_schema_sizes():
    s = make_schema("1/s", "avg", "1h")
    assert (s.chunk_ms, s.partition_ms, s.aggregates) == (times.HOUR, 48 * times.HOUR, ["count", "sum"])
    for ok in ("30m", "1d", "48h"):
        check_granularity(times.parse_duration(ok), 96 * times.HOUR)
    for bad in ("7h", "0", "36h"):
        with pytest.raises(ValueError):
            check_granularity(times.parse_duration(bad), 96 * times.HOUR)
    with pytest.raises(ValueError):
        make_schema("9000/s")
    with pytest.raises(ValueError):
        make_schema(label_sets="a")


@pytest.mark.parametrize("text", ["a ==", "a == 'x' b", "(a == '1'", "starts(a)", "a ~ 'x'", "a in ()", "'x"])
def test_bad_filters(spark, text):
    with pytest.raises(ValueError):
        parse_filter(text)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tempora.sources.files import shared_root

    def session(master, at=None):
        conf = SimpleNamespace(get=lambda key, default=None: at)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_root(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert "tempora" in shared_root(session("local[2]"))
    with pytest.raises(ValueError):
        shared_root(session("spark://host:7077"))


def test_grouping_text(spark):
    from pyspark.sql import functions as F

    from tempora.functions.labels import lset, lset_of, subset

    df = spark.createDataFrame([({"b": "x=1,y", "a": "p\\q", "c": ""},), ({"a": "é", "b": "2", "z": "3"},)], "labels map<string,string>")
    rows = df.select(lset(subset(F.col("labels"), ["b", "a"])).alias("x"), lset_of(F.col("labels"), ["b", "a"]).alias("y"), lset_of(F.col("labels"), []).alias("z")).collect()
    assert all(r["x"] == r["y"] and r["z"] == "" for r in rows) and rows[0]["y"] == "a=p\\\\q,b=x\\=1\\,y"

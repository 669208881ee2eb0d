"""Answers to small inputs worked out by hand from the cell rules."""

import math

import pytest
from pyspark.sql import functions as F

from tempora.functions.times import DAY, HOUR, MINUTE
from tempora.operators import metadata
from tempora.operators.aggregate import merged, over_labels, rolled_up
from tempora.operators.grid import sampled_text
from tempora.plans.planner import long_form, overlap, rollups_fit, select
from tempora.plans.spec import Column, Query
from tempora.plans.sql import parse_select
from tempora.sources.samples import from_rows

T = 1_532_209_200_000
M, D = MINUTE, DAY
CPU = [(0, 10), (M, 20), (2 * M, 30), (3 * M, 40)]


def series(spark, *groups):
    return from_rows(spark, [(m, ls, T + t, v) for m, ls, points in groups for t, v in points])


def cpu(spark, points=CPU, **labels):
    return series(spark, ("cpu", labels or {"os": "linux"}, points))


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("lset", "time").collect()] if "lset" in df.columns else [tuple(r[n] for n in names) for r in df.orderBy("time").collect()]


def at(rows):
    return [((r[0] - T) // M, *r[1:]) for r in rows]


def test_zero_step(spark):
    q = Query(T, T + 10 * M, [Column("cpu", f) for f in ("max", "sum", "count", "min")])
    assert values(select(cpu(spark), q), "time", "max(cpu)", "sum(cpu)", "count(cpu)", "min(cpu)") == [(T, 40, 100, 4, 10)]


def test_alias(spark):
    columns, _, where, groups = parse_select("select max(cpu) as top from t where os == 'linux'")
    assert values(select(cpu(spark), Query(T, T + 10 * M, columns, 0, 0, where, groups)), "top") == [(40,)]


def test_raw_alignment(spark):
    rows = series(spark, ("cpu", {"os": "linux"}, [(-7 * D, 10), (M, 20), (2 * M, 30), (4 * M, 40)]), ("diskio", {"os": "linux"}, [(-5 * D, 10), (2 * M, 20), (3 * M, 30), (4 * M, 40)]))
    got = values(select(rows, Query(T - 8 * D, T + 5 * M, [Column("cpu"), Column("diskio")])), "cpu", "diskio")
    assert got == [(10, None), (None, 10), (20, None), (30, 20), (None, 30), (40, 40)]
    one = series(spark, ("cpu", {"os": "linux"}, CPU), ("diskio", {"os": "linux"}, [(-7 * D, 10)]))
    assert values(select(one, Query(T + M, T + 4 * M, [Column("cpu"), Column("diskio")])), "cpu", "diskio") == [(20, None), (30, None), (40, None)]


def test_text_alignment(spark):
    rows = series(spark, ("cpu", {}, [(0, 10), (M, 20), (2 * M, 30), (4 * M, 50)]), ("log", {}, [(0, "a"), (2 * M, "c"), (3 * M, "d"), (4 * M, "e")]))
    got = values(select(rows, Query(T, T + 5 * M, [Column("cpu"), Column("log")]), frozenset({"log"})), "cpu", "log")
    assert got == [(10, "a"), (20, None), (30, "c"), (None, "d"), (50, "e")]


def test_gaps(spark):
    rows = series(spark, ("cpu1", {}, [(-7 * D, 10), (-4 * D, 20)]), ("cpu2", {}, [(-D, 30)]))
    q = Query(T - 7 * D, T, [Column("*", "count")], M)
    got = [(r["metric"], r["time"] - T, r["count"]) for r in select(rows, q).orderBy("time").collect()]
    assert got == [("cpu1", -7 * D, 1), ("cpu1", -4 * D, 1), ("cpu2", -D, 1)]
    got = [(r["metric"], r["time"] - T) for r in select(rows, Query(T - 7 * D, T, [Column("*", interpolator="next_val")], M)).orderBy("time").collect()]
    assert got == [("cpu1", -7 * D), *(("cpu1", -4 * D - i * M) for i in (2, 1, 0)), *(("cpu2", -D - i * M) for i in (2, 1, 0))]


def test_downsample(spark):
    rows = cpu(spark, [(0, 10), (M, 20), (6 * M, 30), (9 * M, 40)])
    got = at(values(select(rows, Query(T, T + 10 * M, [Column("cpu", interpolator="next_val")], 2 * M)), "time", "cpu"))
    assert got == [(0, 10), (2, 30), (4, 30), (6, 30), (8, 40)]
    got = at(values(select(rows, Query(T, T + 10 * M, [Column("cpu", interpolator="linear")], 2 * M)), "time", "cpu"))
    assert got == [(0, 10), (2, 22), (4, 26), (6, 30), (8, pytest.approx(36 + 2 / 3))]
    got = values(select(rows, Query(T, T + 10 * M, [Column("cpu", interpolator="nan")], 2 * M)), "cpu")
    assert [math.isnan(v) for (v,) in got] == [False, True, True, False, True]


def test_downsample_without_interpolator(spark):
    h = [(2 * HOUR + 10, 10), (2 * HOUR + 19 * M, 20), (2 * HOUR + 40 * M, 30), (5 * HOUR, 40)]
    got = values(select(cpu(spark, h), Query(T, T + 6 * HOUR, [Column("cpu")], 2 * HOUR)), "time", "cpu")
    assert [((t - T) // HOUR, v) for t, v in got] == [(0, 10), (2, 10), (4, 40)]


def test_sampled_text(spark):
    rows = series(spark, ("log", {}, [(M, "a"), (5 * M, "b")]))
    got = sampled_text(rows, T, T + 6 * M, 2 * M, 2 * M).orderBy("k").collect()
    assert [(r["k"], r["s"]) for r in got] == [(0, "a"), (2, "b")]


def test_intervals(spark):
    rows = cpu(spark, [(-7 * D, 10), (0, 20), (2 * M, 30), (3 * M, 40)])
    q = Query(T - 7 * D, T + 10 * M, [Column("cpu", f) for f in ("min", "max", "sum")], 5 * M)
    assert values(select(rows, q), "time", "min(cpu)", "max(cpu)", "sum(cpu)") == [(T - 7 * D, 10, 10, 10), (T, 20, 40, 90)]


def test_derived(spark):
    rows = cpu(spark, [(-7 * D, 10), (-7 * D + M, 12), (M, 20), (2 * M, 30), (3 * M, 40), (6 * M, 1)])
    q = Query(T - 7 * D, T + 10 * M, [Column("cpu", f) for f in ("avg", "stdvar", "stddev", "sqr", "last")], 5 * M)
    assert values(select(rows, q), "time", "avg(cpu)", "stdvar(cpu)", "stddev(cpu)", "sqr(cpu)", "last(cpu)") == [(T - 7 * D, 11, 2, pytest.approx(2**0.5), 244, 12), (T, 30, 100, 10, 2900, 40), (T + 5 * M, 1, None, None, 1, 1)]


@pytest.mark.parametrize(("width", "expected"), [(6, [0, 150, 390]), (2, [0, 120, 170]), (5, [0, 150, 300])])
def test_windows(spark, width, expected):
    rows = cpu(spark, [(i * M, 10 * i) for i in range(10)])
    got = values(select(rows, Query(T, T + 10 * M, [Column("cpu", "sum")], 5 * M, width * M)), "sum(cpu)")
    assert [v for (v,) in got] == expected


def test_window_before_start(spark):
    rows = cpu(spark, [(-20 * M, 1), (-15 * M, 2), (-13 * M, 3), (0, 4), (10 * M, 5), (20 * M, 6)])
    got = values(select(rows, Query(T, T + 20 * M, [Column("cpu", "sum")], 10 * M, 30 * M)), "sum(cpu)")
    assert [v for (v,) in got] == [10, 15, 15]


HOURLY = [(i * HOUR, 10 * i) for i in range(10)]


@pytest.mark.parametrize(("step", "width", "expected"), [(5, 6, [0, 150, 350]), (5, 5, [0, 150, 300])])
def test_rollup_windows(spark, step, width, expected):
    rows = cpu(spark, HOURLY)
    q = Query(T, T + 10 * HOUR, [Column("cpu", "sum")], step * HOUR, width * HOUR, rollups=True)
    got = [v for (v,) in values(select(rows, q, rollups=rolled_up(rows, HOUR), granularity=HOUR), "sum(cpu)")]
    assert got == expected


def test_rollup_intervals(spark):
    rolled = lambda rows: {"rollups": rolled_up(rows, HOUR), "granularity": HOUR}
    rows = cpu(spark)
    q = Query(T - 4 * HOUR, T + 10 * M, [Column("cpu", f) for f in ("sum", "min", "max")], 4 * HOUR, rollups=True)
    assert values(select(rows, q, **rolled(rows)), "time", "sum(cpu)", "min(cpu)", "max(cpu)") == [(T - 4 * HOUR, 100, 10, 40)]
    rows = cpu(spark, [(-7 * D, 10), (M, 20), (2 * M, 30), (3 * M, 40)])
    q = Query(T - 7 * D - HOUR, T + 10 * M, [Column("cpu", "sum")], 4 * HOUR, rollups=True)
    assert values(select(rows, q, **rolled(rows)), "time", "sum(cpu)") == [(T - 7 * D - HOUR, 10), (T - HOUR, 90)]


def test_rollups_equal_raw_where_cells_are_buckets(spark):
    base = T // HOUR * HOUR
    rows = from_rows(spark, [("m", {"a": str(i % 3)}, base + i * 7 * M, float(i * i % 17)) for i in range(200)])
    q = Query(base, base + 24 * HOUR, [Column("m", f) for f in ("count", "sum", "min", "max", "avg", "last")], 4 * HOUR)
    raw = [tuple(r) for r in select(rows, q).drop("labels").orderBy("lset", "time").collect()]
    from dataclasses import replace

    rolled = select(rows, replace(q, rollups=True), rollups=rolled_up(rows, HOUR), granularity=HOUR)
    assert [tuple(r) for r in rolled.drop("labels").orderBy("lset", "time").collect()] == raw


def test_rollup_route():
    q = Query(0, 10 * HOUR, [Column("m", "avg")], 4 * HOUR)
    assert rollups_fit(q, HOUR, ["count", "sum"]) and not rollups_fit(q, HOUR, ["count"])
    assert not rollups_fit(q, 2 * HOUR, ["count", "sum"])
    assert not rollups_fit(Query(0, 10 * HOUR, [Column("m", "avg_all")], 4 * HOUR), HOUR, ["count", "sum"])
    assert rollups_fit(Query(0, 10 * HOUR, [Column("m", "avg")], HOUR), HOUR, ["count", "sum"], client=False)


def two(spark, linux, mac):
    return series(spark, ("cpu", {"os": "linux"}, linux), ("cpu", {"os": "mac"}, mac))


def across(rows, functions, step, stop, interpolator="none", start=T, tolerance=0, **more):
    q = Query(start, stop, [Column("cpu", f"{f}_all", interpolator=interpolator, tolerance=tolerance) for f in functions], step, **more)
    return at(values(select(rows, q), "time", *[f"{f}(cpu)" for f in functions]))


def test_across_series(spark):
    linux, mac = [(0, 10), (2 * M, 20), (4 * M, 30)], [(0, 20), (2 * M, 30), (4 * M, 40)]
    want = [(0, 30, 10, 15), (2, 50, 20, 25), (4, 70, 30, 35)]
    assert across(two(spark, linux, mac), ["sum", "min", "avg"], 2 * M, T + 5 * M) == want
    noise = [(M, 1), (3 * M, 1)]
    assert across(two(spark, sorted(linux + noise), sorted(mac + noise)), ["sum", "min", "avg"], 2 * M, T + 5 * M) == want


def test_across_series_previous(spark):
    rows = two(spark, [(0, 10), (M, 20), (3 * M, 30), (5 * M, 40)], [(0, 20), (2 * M, 30), (4 * M, 40)])
    assert across(rows, ["sum", "min", "max"], 2 * M, T + 5 * M, "prev_val") == [(0, 30, 10, 20), (2, 50, 20, 30), (4, 70, 30, 40)]
    rows = two(spark, [(0, 10), (M, 20), (10 * M, 30)], [(0, 20), (5 * M, 30), (10 * M, 40)])
    assert across(rows, ["sum"], 5 * M, T + 10 * M, "prev_val", tolerance=M) == [(0, 30), (5, 30), (10, 70)]
    rows = two(spark, [(0, 10), (M, 1), (3 * M, 20), (5 * M, 20)], [(0, 20), (2 * M, 1), (5 * M, 20)])
    assert across(rows, ["avg"], 2 * M, T + 5 * M, "prev_val") == [(0, 15), (2, 1), (4, 10.5)]
    d = -7 * D
    rows = two(spark, [(d, 10), (d + M, 1), (d + 3 * M, 20), (0, 20), (M, 1), (2 * M, 60)], [(d, 20), (d + 2 * M, 1), (0, 30), (M, 1), (3 * M, 40)])
    got = across(rows, ["sum"], 2 * M, T + 4 * M, "prev_val", start=T + d)
    assert got == [(d // M, 30), (d // M + 2, 2), (d // M + 4, 21), (d // M + 6, 21), (0, 50), (2, 61)]


def test_group_by(spark):
    rows = series(spark, *[("cpu", {"os": os, "region": r}, [(0, 10)]) for os, r in (("linux", "a"), ("linux", "b"), ("linux", "c"), ("mac", "a"))])
    q = Query(T, T + 2 * M, [Column("cpu", "sum"), Column("cpu", "count")], 2 * M, group_by=["os"])
    assert values(select(rows, q), "lset", "sum(cpu)", "count(cpu)") == [("os=linux", 30, 3), ("os=mac", 10, 1)]
    q = Query(T, T + 2 * M, [Column("cpu", "sum_all")], 2 * M, group_by=["os"])
    assert values(select(rows, q), "lset", "sum(cpu)") == [("os=linux", 30), ("os=mac", 10)]
    with pytest.raises(Exception, match="lacks a label"):
        select(rows, Query(T, T + 2 * M, [Column("cpu", "sum")], 2 * M, group_by=["dc"])).collect()


def test_text_is_counted(spark):
    rows = series(spark, ("log", {}, [(i * M, "abcdef"[i]) for i in range(6)]))
    got = select(rows, Query(T - D, T + D, [Column("*", "count")], 10 * M)).collect()
    assert [(r["metric"], r["time"], r["count"]) for r in got] == [("log", T, 6)]


def test_overlapping_windows(spark):
    data = [(1532940510, 314.3), (1532944110, 314.3), (1532947710, 300.3), (1532951310, 3234.6)]
    rows = from_rows(spark, [("cpu", {}, t, v) for t, v in data])
    q = Query(0, 1532954910, [Column("cpu", f) for f in ("sum", "count", "sqr")], 3600)
    got = values(overlap(rows, q, [1, 2, 4]), "time", "sum(cpu)", "count(cpu)", "sqr(cpu)")
    assert got == [(1532937600, pytest.approx(4163.5), 4, pytest.approx(10750386.23)), (1532944800, pytest.approx(3534.9), 2, pytest.approx(10552817.25)), (1532948400, pytest.approx(3234.6), 1, pytest.approx(10462637.16))]


def test_rate(spark):
    rows = cpu(spark, [(0, 10), (M, 20), (2 * M, 50), (5 * M, 80)])
    got = at(values(select(rows, Query(T, T + 5 * M, [Column("cpu", "rate")], M)), "time", "rate(cpu)"))
    assert got == [(0, None), (1, pytest.approx(10 / 60)), (2, pytest.approx(0.5)), (5, None)]


def test_mixed(spark):
    got = values(select(cpu(spark), Query(T, T + 4 * M, [Column("cpu", "avg", interpolator="next_val"), Column("cpu", interpolator="next_val")], 2 * M)), "avg(cpu)", "cpu")
    assert got == [(15, 10), (35, 30)]


@pytest.mark.parametrize(("text", "n"), [("os == 'linux'", 1), ("os = 'linux' or os = 'mac'", 2), ("not os == 'linux'", 2), ("starts(os, 'm')", 1), ("exists(dc)", 1), ("dc > 5", 1), ("dc >= 10 and 1==1", 0), ("__name__ == 'cpu'", 3), ("os in ('mac', 'x')", 1), ("os not in ('mac')", 2), ("dc != '7'", 2)])
def test_filters(spark, text, n):
    rows = series(spark, ("cpu", {"os": "linux", "dc": "7"}, [(0, 1)]), ("cpu", {"os": "mac"}, [(0, 1)]), ("cpu", {"os": "bsd"}, [(0, 1)]))
    assert select(rows, Query(T, T + 1, [Column("cpu", "sum")], filter=text)).count() == n


def test_metadata(spark):
    rows = series(spark, ("a", {"x": "1"}, [(0, 1), (3 * D, 1)]), ("a", {"x": "2", "y": "1"}, [(0, 1)]), ("b", {}, [(0, 1)]))
    assert sorted(r[0] for r in metadata.metric_names(rows).collect()) == ["a", "b"]
    assert sorted(r[0] for r in metadata.label_values(rows, "x").collect()) == ["1", "2"]
    assert sorted(r[0] for r in metadata.label_names(rows).collect()) == ["x", "y"]
    assert metadata.label_sets(rows).count() == 3 and metadata.label_sets(rows, "a").count() == 2
    assert metadata.count_series(rows, 2 * D).first()[0] == 4


def test_merging_rollups_is_associative(spark):
    rows = from_rows(spark, [("m", {"a": str(i % 2)}, T + i * 9 * M, float(i)) for i in range(60)])
    whole = rolled_up(rows, HOUR)
    parts = [rolled_up(rows.where(F.col("t_ms") % 3 == i), HOUR) for i in range(3)]
    once = merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    twice = merged(merged(parts[2].unionByName(parts[0])).unionByName(parts[1]))
    read = lambda d: sorted(tuple(r) for r in d.select("lset", "bucket_ms", "count", "sum", "sqr", "min", "max", "last", "last_t").collect())
    assert read(whole) == read(once) == read(twice)
    assert over_labels(whole, ["a"]).count() == whole.count() and over_labels(whole, ["b"]).count() == 0


def test_sums_leave_out_what_is_not_finite(spark):
    rows = from_rows(spark, [("m", {}, T, 1.0), ("m", {}, T + 1, float("nan")), ("m", {}, T + 2, float("inf"))])
    r = rolled_up(rows, HOUR).first()
    assert (r["count"], r["sum"], r["sqr"]) == (3, 1.0, 1.0)


def test_long_form(spark):
    q = Query(T, T + 10 * M, [Column("cpu", "max"), Column("cpu", "stddev")], 2 * M)
    got = [(r["metric"], r["aggregate"], r["value"]) for r in long_form(select(cpu(spark, CPU[:3]), q), q).orderBy("aggregate", "time").collect()]
    assert got == [("cpu", "max", 20), ("cpu", "max", 30), ("cpu", "stddev", pytest.approx(50**0.5))]


def test_partitions_are_pruned_and_filters_pushed(spark, tmp_path):
    from tempora.sources.schema import make_schema
    from tempora.sources.table import Table

    table = Table.create(spark, str(tmp_path / "t"), make_schema(aggregates="*"))
    table.append(series(spark, ("cpu", {}, [(i * D, float(i)) for i in range(10)])))
    plan = table.select(Query(T, T + D, [Column("cpu", "sum")], HOUR))._jdf.queryExecution().executedPlan().toString()
    assert "part_start" in plan.split("PartitionFilters")[1][:200] and "IsNotNull(metric)" in plan and "(t_ms," in plan
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_long_series_are_cut_into_stretches_of_time(spark, monkeypatch):
    """Every interpolator gives the same, whatever the stretches and the parts of gaps are."""
    from tempora.operators import grid

    points = [(T + t, float(i)) for i, t in enumerate([0, 3, 3, 40, 41, 400, 407, 1000, 1001, 1002, 2500])]
    rows = series(spark, ("cpu", {}, [(t - T, v) for t, v in points]), ("cpu", {"os": "x"}, [(5, 1.0), (5, 0.5), (1999, 2.0)]))
    for name in ("none", "nan", "prev_val", "next_val", "linear"):
        answers = []
        for stretch, part in ((7 * D, 10_000), (10, 3), (1, 1), (500, 7)):
            monkeypatch.setattr(grid, "STRETCH", stretch)
            monkeypatch.setattr(grid, "PART", part)
            got = grid.sampled(rows, T, T + 2600, 7, name, 60).collect()
            answers.append(sorted((r["lset"], r["k"], str(r["v"])) for r in got))
        assert answers[0] and all(a == answers[0] for a in answers)
    assert [(r["k"], r["v"]) for r in grid.sampled(rows, T, T + 20, 1, "prev_val", 60).where("lset = 'os=x'").collect()] == [(5, 0.5)]

import json

import pytest

from tempora.cli import main, make_query, query_json
from tempora.functions.times import DAY, HOUR, MINUTE
from tempora.plans.spec import Column, Query
from tempora.sources import formats, samples
from tempora.sources.samples import from_arrays, from_rows, read_csv, read_json
from tempora.sources.schema import make_schema
from tempora.sources.table import Table, accepted
from tempora.streaming.ingest import events_stream, into_table, monotonic

BASE = 1_563_667_200_000  # 2019-07-21


def rows(spark, *points):
    return from_rows(spark, points)


@pytest.fixture
def table(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), make_schema("1/s", "*", "1h", "os"))
    points = [(m, {"os": os, "dc": "1"}, BASE + p * 2 * DAY + c * HOUR + i * MINUTE, 1.2 + 0.1 * i) for m in ("cpu", "disk") for os in ("win", "linux") for p in range(3) for c in (0, 1) for i in range(3 - c)]
    t.append(rows(spark, *points))
    return t


def left(t):
    return sorted((r["metric"], r["lset"], r["t_ms"]) for r in t.samples().collect())


def test_create_and_open(spark, tmp_path, table):
    with pytest.raises(FileExistsError):
        Table.create(spark, table.path, make_schema())
    with pytest.raises(FileNotFoundError):
        Table.open(spark, str(tmp_path / "none"))
    again = Table.open(spark, table.path)
    assert again.schema.partitions == [BASE + i * 2 * DAY for i in range(3)] == again.partitions()
    info = again.describe(names=True, count=True)
    assert info["metrics"] == ["cpu", "disk"] and info["series"] == 12


def test_delete_ranges(spark, table):
    before = left(table)
    table.delete(BASE + 2 * DAY + MINUTE, BASE + 2 * DAY + HOUR, ["cpu"], "os == 'win'")
    want = [x for x in before if not (x[0] == "cpu" and "os=win" in x[1] and BASE + 2 * DAY + MINUTE <= x[2] <= BASE + 2 * DAY + HOUR)]
    assert left(table) == want and len(want) < len(before)
    rolled = {(r["metric"], r["lset"], r["bucket_ms"]): r["count"] for r in table.rollups().collect()}
    expected = {}
    for m, ls, t in want:
        key = m, ls, t // HOUR * HOUR
        expected[key] = expected.get(key, 0) + 1
    assert rolled == expected
    assert table.preaggregates(["os"]).count() == len({(m, "os" + ls.split("os")[1], b) for m, ls, b in expected})


def test_delete_whole_partitions(spark, table):
    table.delete(BASE, BASE + 4 * DAY - 1)
    assert table.partitions() == [BASE + 4 * DAY] == table.schema.partitions
    assert all(t >= BASE + 4 * DAY for *_, t in left(table))
    table.delete(0, BASE + 100 * DAY)
    assert left(table) == [] and table.schema.partitions == []


def test_delete_metrics_that_empty_a_partition(spark, table):
    table.delete(BASE, BASE + 2 * DAY - 1, ["cpu", "disk"])
    assert table.schema.partitions == [BASE + 2 * DAY, BASE + 4 * DAY]


def test_delete_all(spark, table):
    table.delete_all()
    with pytest.raises(FileNotFoundError):
        Table.open(spark, table.path)


def test_query_is_clamped_to_partitions(spark, table):
    q = table.clamped(Query(0, BASE + 100 * DAY, [Column("cpu", "count")], DAY))
    assert (q.start, q.stop) == (BASE, BASE + 6 * DAY - 1)
    got = table.select(Query(0, BASE + 100 * DAY, [Column("cpu", "count")], 2 * DAY, group_by=["os"])).collect()
    assert {(r["lset"], r["time"], r["count(cpu)"]) for r in got} == {(f"os={o}", BASE + p * 2 * DAY, 5) for o in ("win", "linux") for p in range(3)}
    rolled = table.select(Query(BASE, BASE + 6 * DAY - 1, [Column("cpu", "count")], 2 * DAY, group_by=["os"], rollups=True)).collect()
    assert sum(r["count(cpu)"] for r in rolled) == 30


def test_types_and_names_are_checked(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), make_schema())
    t.append(rows(spark, ("cpu", {}, BASE, 1.0)))
    for bad in ([("cpu", {}, BASE + 1, "x")], [("cpu-1", {}, BASE, 1.0)], [("a", {}, -5, 1.0)], [("b", {}, BASE, 1.0), ("b", {}, BASE + 1, "x")], [("c", {}, BASE, None)]):
        with pytest.raises(ValueError):
            t.append(rows(spark, *bad))
    assert t.samples().count() == 1


def test_duplicates_and_late_samples(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), make_schema(aggregates="count"))
    t.append(rows(spark, *[("cpu", {"s": s}, BASE, v) for s in "ab" for v in (1.0, 2.0)]))
    assert t.samples().count() == 2
    t.append(rows(spark, ("cpu", {"s": "a"}, BASE, 9.0), ("cpu", {"s": "a"}, BASE + 2 * HOUR, 3.0)))
    t.append(rows(spark, ("cpu", {"s": "a"}, BASE + HOUR, 4.0)))
    assert t.samples().count() == 3
    t.append(rows(spark, ("cpu", {"s": "a"}, BASE + 2 * HOUR - 58 * MINUTE, 5.0), ("cpu", {"s": "a"}, BASE + HOUR, 6.0), ("cpu", {"s": "a"}, BASE + 2 * HOUR, 7.0)), override=True)
    assert sorted((r["t_ms"] - BASE, r["v"]) for r in t.samples().where("lset = 's=a'").collect()) == [(0, 1.0), (62 * MINUTE, 5.0), (2 * HOUR, 7.0)]
    assert t.rollups().selectExpr("sum(count)").first()[0] == 4


def test_arrival_decides_among_equal_times(spark):
    from pyspark.sql import functions as F

    batch = rows(spark, ("a", {}, 5, 1.0), ("a", {}, 5, 2.0)).withColumn("arrival", F.col("v"))
    assert accepted(batch, None).first()["v"] == 1.0 and accepted(batch, None, True).first()["v"] == 2.0


def test_one_writer(spark, table):
    with table.writing(), pytest.raises(RuntimeError), table.writing():
        pass


def test_appending_again_changes_nothing(spark, table):
    before = left(table)
    table.append(table.samples().drop("part_start"))
    assert left(table) == before


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'cpu,"os=mac,dc=7",3.5,{BASE}\ncpu,,4,{BASE + 1}\nlog,a=b,text,\n')
    got = {r["metric"] + r["lset"]: (r["t_ms"], r["v"], r["s"]) for r in read_csv(spark, str(tmp_path / "a.csv"), now=77).collect()}
    assert got == {"cpudc=7,os=mac": (BASE, 3.5, None), "cpu": (BASE + 1, 4.0, None), "loga=b": (77, None, "text")}
    (tmp_path / "a.json").write_text(json.dumps({"metric": "cpu", "labels": {"os": "mac"}, "samples": [{"t": str(BASE), "v": {"n": 1}}, {"t": str(BASE + 5), "v": {"n": 2.5}}]}))
    assert [(r["t_ms"] - BASE, r["v"]) for r in read_json(spark, str(tmp_path / "a.json")).orderBy("t_ms").collect()] == [(0, 1.0), (5, 2.5)]


def test_arrays(spark):
    got = from_arrays(spark, "cpu", "os=mac", "1,2.5", "1000,now-1s", now=5000).orderBy("t_ms").collect()
    assert [(r["t_ms"], r["v"]) for r in got] == [(1000, 1.0), (4000, 2.5)]
    for bad in (("1,x", ""), ("x,1", ""), ("1,2", "5"), ("1", "soon")):
        with pytest.raises(ValueError):
            from_arrays(spark, "cpu", "", *bad)


def test_formats(spark):
    answer = spark.createDataFrame([("cpu", {"os": "a"}, "os=a", "max", 1_000_000, 1.5), ("cpu", {"os": "a"}, "os=a", "max", 1_060_000, 2.0)], "metric string, labels map<string,string>, lset string, aggregate string, time long, value double")
    assert list(formats.lines(answer, "text"))[:2] == ["Name: cpu  Labels: Aggregate=max,os=a", "  1970-01-01T00:16:40Z  v=1.50"]
    assert list(formats.lines(answer, "csv"))[0] == 'cpu,"Aggregate=max,os=a",1.500000,1000000'
    assert json.loads("".join(formats.lines(answer, "json"))) == [{"target": "cpu{Aggregate=max,os=a}", "datapoints": [[1.5, 1_000_000], [2.0, 1_060_000]]}]
    assert list(formats.lines(answer, "none")) == ["1 label sets"]
    assert json.loads(formats.json_frame(answer).first()[0])["datapoints"] == [[1.5, 1e6], [2.0, 1.06e6]]
    with pytest.raises(ValueError):
        formats.lines(answer, "xml")


def test_nan_compatible(spark):
    r = formats.nan_compatible(spark.createDataFrame([(None, None, 1)], "v double, s string, n int")).first()
    assert r["v"] != r["v"] and (r["s"], r["n"]) == ("", 1)


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    run = lambda *a: main(["--table", path, *a], spark)
    run("create", "-a", "sum,avg")
    run("add", "cpu", "os=mac", "-d", "1,2,3", "-m", f"{BASE},{BASE + MINUTE},{BASE + 2 * MINUTE}")
    run("query", "cpu", "-a", "sum", "-b", str(BASE), "-e", str(BASE + HOUR), "-i", "1h", "-o", "csv")
    assert f'cpu,"Aggregate=sum,os=mac",6.000000,{BASE}' in capsys.readouterr().out
    run("query", "select max(cpu) as top from t where os == 'mac'", "-b", str(BASE), "-e", str(BASE + HOUR), "-o", "json")
    assert json.loads(capsys.readouterr().out)[0]["datapoints"][0][0] == 3
    assert query_json(Table.open(spark, path), {"metric": "cpu", "aggregators": ["count"], "start_time": str(BASE), "end_time": str(BASE + HOUR), "step": "1h"})[0]["datapoints"] == [[3.0, BASE]]
    run("query", "cpu", "-a", "sum", "-b", str(BASE), "-e", str(BASE + HOUR), "-i", "1h", "-o", "csv", "--prometheus")
    assert f'cpu,"os=mac",6.000000,{BASE}' in capsys.readouterr().out
    run("compact")
    run("vacuum")
    run("unlock")
    assert "pieces removed" in capsys.readouterr().out
    run("info", "-m", "-n")
    assert '"cpu"' in capsys.readouterr().out
    run("check", "cpu", "os=mac")
    assert "samples" in capsys.readouterr().out
    run("delete", "cpu", "-b", str(BASE), "-e", str(BASE + MINUTE), "--force")
    assert Table.open(spark, path).samples().count() == 1
    with pytest.raises(SystemExit):
        run("delete", "--all", "-b", "0")
    run("delete", "--all", "--force")
    main(["time", "0"])
    assert "1970-01-01T00:00:00Z" in capsys.readouterr().out
    main(["version"])


def test_query_words():
    with pytest.raises(ValueError):
        make_query()
    with pytest.raises(ValueError):
        make_query("cpu", last="1h", begin="0")
    q = make_query("cpu", "avg,max", last="2h", step="5m", now=10 * HOUR)
    assert (q.start, q.stop, q.step, len(q.columns)) == (8 * HOUR, 10 * HOUR, 300_000, 2)


def test_stream_into_table(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), make_schema())
    for i in range(2):
        rows(spark, *[("cpu", {}, BASE + (2 * i + j) * MINUTE, float(j)) for j in range(3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = events_stream(spark, str(tmp_path / "in"), samples.SCHEMA)
        into_table(stream, t, str(tmp_path / "ck")).awaitTermination(60)
    assert [r["t_ms"] - BASE for r in t.samples().orderBy("t_ms").collect()] == [i * MINUTE for i in range(5)]


def test_stateful_rule(spark, tmp_path):
    rows(spark, ("cpu", {}, 10, 1.0), ("cpu", {}, 5, 2.0), ("cpu", {}, 10, 3.0), ("cpu", {}, 20, "x"), ("b", {}, 1, 1.0)).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = monotonic(events_stream(spark, str(tmp_path / "in"), samples.SCHEMA))
    q = got.writeStream.format("memory").queryName("monotonic").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["metric"], r["t_ms"], r["v"]) for r in spark.table("monotonic").collect()) == [("b", 1, 1.0), ("cpu", 5, 2.0), ("cpu", 10, 1.0)]


def test_settings(tmp_path):
    from tempora.config import load

    (tmp_path / "c.json").write_text(json.dumps({"table": "a", "rate": "2/s", "token": "secret"}))
    c = load(str(tmp_path / "c.json"), {"TEMPORA_RATE": "3/s", "TEMPORA_OVERRIDE": "true"}, granularity="30m", output="")
    assert (c.table, c.rate, c.granularity, c.override, c.output) == ("a", "3/s", "30m", True, "text")
    assert "secret" not in str(c) and "secret" not in repr(c)
    with pytest.raises(ValueError):
        load("", {}, colour="red")


def test_text_is_downsampled(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), make_schema())
    t.append(rows(spark, *[("log", {}, BASE + i * MINUTE, "abc"[i]) for i in range(3)], *[("cpu", {}, BASE + i * MINUTE, float(i)) for i in range(3)]))
    got = t.select(Query(BASE, BASE + 4 * MINUTE, [Column("log", interpolator="next_val"), Column("cpu", interpolator="next_val")], 2 * MINUTE)).orderBy("time").collect()
    assert [(r["time"] - BASE, r["log"], r["cpu"]) for r in got] == [(0, "a", 0.0), (2 * MINUTE, "c", 2.0)]


def test_counters(spark):
    from tempora.streaming.metrics import counted

    df, seen = counted(rows(spark, ("cpu", {}, 5, 1.0), ("log", {}, 9, "x")), "batch")
    df.collect()
    assert seen.get == {"samples": 2, "first_t": 5, "last_t": 9, "text_samples": 1}


def state(t):
    return left(t), sorted((r["metric"], r["lset"], r["bucket_ms"], r["count"], r["last"]) for r in t.rollups().collect()), sorted((r["lset"], r["bucket_ms"], r["count"]) for r in t.preaggregates(["os"]).collect()), t.partitions()


@pytest.mark.parametrize("override", [False, True])
def test_a_writer_that_dies_anywhere_leaves_the_table_as_it_was(spark, table, monkeypatch, override):
    before = state(table)
    batch = rows(spark, *[("cpu", {"os": os, "dc": "1"}, BASE + 6 * DAY - i * MINUTE, float(i)) for os in ("win", "mac") for i in range(3)], ("cpu", {"os": "win", "dc": "1"}, BASE + 9 * DAY, 1.0))
    steps = []
    for name in ("_write", "_commit"):
        own = getattr(Table, name)
        monkeypatch.setattr(Table, name, lambda self, *a, own=own, **k: (steps.append(1), own(self, *a, **k))[1])
    n = 0
    while True:
        steps.clear()
        n += 1
        for name in ("_write", "_commit"):
            own = getattr(Table, name)
            monkeypatch.setattr(Table, name, lambda self, *a, own=own, **k: (_ for _ in ()).throw(OSError("gone")) if len(steps) == n - 1 else own(self, *a, **k))
        try:
            table.append(batch, override)
            break
        except OSError:
            assert state(Table.open(spark, table.path)) == before, n
        finally:
            monkeypatch.undo()
            for name in ("_write", "_commit"):
                own = getattr(Table, name)
                monkeypatch.setattr(Table, name, lambda self, *a, own=own, **k: (steps.append(1), own(self, *a, **k))[1])
    monkeypatch.undo()
    assert n == 6  # four kinds of pieces and the commit, then none is left to fail
    clean = Table.create(spark, table.path + "-clean", table.schema)
    clean.append(Table.open(spark, table.path).samples().where(f"t_ms < {BASE + 5 * DAY}").drop("part_start"))
    clean.append(batch, override)
    assert state(clean) == state(Table.open(spark, table.path))
    assert table.vacuum() > 0 and state(table) == state(clean) and table.vacuum() == 0


def test_locks_that_writers_left_are_broken(spark, table):
    table.files.write("_lock", "5")
    table.append(rows(spark, ("cpu", {"os": "win", "dc": "1"}, BASE + 9 * DAY, 1.0)))
    assert not table.files.exists("_lock")
    table.files.write("_lock", str(2**62))
    with pytest.raises(RuntimeError):
        table.append(rows(spark, ("cpu", {"os": "win", "dc": "1"}, BASE + 10 * DAY, 1.0)))
    table.break_lock()
    other = Table.open(spark, table.path)
    other.append(rows(spark, ("cpu", {"os": "win", "dc": "1"}, BASE + 11 * DAY, 1.0)))
    with pytest.raises(RuntimeError):
        table._commit(table.pieces)  # another writer was faster


def test_readers_keep_the_version_that_they_have(spark, table):
    old = table.samples()
    n = old.count()
    Table.open(spark, table.path).delete(BASE, BASE + 2 * DAY)
    assert old.count() == n > Table.open(spark, table.path).samples().count()


def test_appends_read_no_samples_and_pieces_are_made_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tempora.sources.table.MAX_PIECES", 4)
    t = Table.create(spark, str(tmp_path / "t"), make_schema(aggregates="*"))
    read = t._read
    monkeypatch.setattr(t, "_read", lambda kind, *a, **k: read(kind, *a, **k) if kind == "series" or k.get("parts") else pytest.fail(kind))
    for i in range(5):
        t.append(rows(spark, ("cpu", {}, BASE + i * MINUTE, float(i))))
    monkeypatch.undo()
    assert {len(ids) for ids in t.pieces["samples"].values()} == {2} and t.samples().count() == 5
    assert [(r["count"], r["sum"], r["last"]) for r in t.rollups().collect()] == [(5, 10.0, 4.0)]
    t.compact()
    assert [r["samples"] for r in t.series().collect()] == [5] and t.metric_names().count() == 1
    t.append(rows(spark, ("cpu", {}, BASE, 1.0)))  # nothing new
    assert t.samples().count() == 5


def test_rollups_serve_a_query_by_themselves_where_the_answer_is_the_same(spark, table):
    columns = [Column("cpu", f) for f in ("count", "sum", "min", "max", "avg", "stddev")]
    whole = Query(BASE, BASE + 6 * DAY - 1, columns, 6 * HOUR)
    cut = Query(BASE + MINUTE, BASE + 6 * DAY - 1, columns, 6 * HOUR)
    for q, rolled in ((whole, True), (cut, False), (Query(BASE, BASE + DAY, columns, 6 * HOUR), False), (Query(BASE, BASE + 6 * DAY - 1, [Column("cpu", "rate")], 6 * HOUR), False)):
        frame = table.select(q)
        assert ("bucket_ms" in frame._jdf.queryExecution().optimizedPlan().toString()) == rolled, q
        a, b = ([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f.drop("labels").orderBy("lset", "time").collect()] for f in (frame, table.select(q, rollups=False)))
        assert a == b
    table.append(rows(spark, ("cpu", {"os": "mac", "dc": "2"}, BASE + 7 * DAY, float("inf"))))
    assert "bucket_ms" not in table.select(whole)._jdf.queryExecution().optimizedPlan().toString()


def test_streams_are_tried_again_and_drained(spark, tmp_path):
    from tempora.streaming.ingest import drained

    t = Table.create(spark, str(tmp_path / "t"), make_schema(aggregates="*"))
    source = str(tmp_path / "in")
    rows(spark, *[("cpu", {}, BASE + i, float(i)) for i in range(4)]).write.parquet(source)
    stream, failures, add = events_stream(spark, source, samples.SCHEMA), [1, 1], t.append

    def append(*args):
        if failures:
            failures.pop()
            raise OSError("not now")
        add(*args)

    t.append = append
    query = into_table(stream, t, str(tmp_path / "check"), processingTime="1 second")
    assert drained(query, 60) and Table.open(spark, t.path).samples().count() == 4
    query.stop()
    with pytest.raises(ValueError):
        t.select_prometheus(Query(0, 1, [Column("*")]))


def test_the_last_time_rule_is_called_for_groups_of_series(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tempora.streaming.ingest.SERIES_GROUPS", 4, raising=False)
    first = [("m", {"i": str(i)}, 10, "x" if i == 7 else 1.0) for i in range(40)] + [("m", {}, 20, 1.0)]
    second = [("m", {"i": str(i)}, 10 + i % 2, 2.0) for i in range(40)] + [("m", {"new": "1"}, 5, 3.0), ("m", {}, 20, 2.0), ("m", {}, 21, 4.0)]
    for points in (first, second):
        rows(spark, *points).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = monotonic(events_stream(spark, str(tmp_path / "in"), samples.SCHEMA, maxFilesPerTrigger="1"))
    q = got.writeStream.format("memory").queryName("groups").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    taken = first + [("m", {"i": str(i)}, 11, 2.0) for i in range(1, 40, 2) if i != 7] + [("m", {"new": "1"}, 5, 3.0), ("m", {}, 21, 4.0)]
    key = lambda r: (str(r[1]), r[2])
    assert sorted(((r["metric"], r["labels"], r["t_ms"], r["s"] or r["v"]) for r in spark.table("groups").collect()), key=key) == sorted(taken, key=key)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_last_times_are_joined_only_to_batches_with_late_samples(spark, tmp_path, monkeypatch):
    given = []
    monkeypatch.setattr("tempora.sources.table.accepted", lambda batch, last, *a, **k: given.append(last is not None) or accepted(batch, last, *a, **k))
    t = Table.create(spark, str(tmp_path / "t"), make_schema(aggregates="*"))
    for points in ([("cpu", {}, 10, 1.0), ("cpu", {}, 10, 0.5)], [("cpu", {}, 11, 2.0), ("disk", {}, 5, 3.0)], [("cpu", {}, 11, 9.0), ("cpu", {}, 12, 4.0), ("disk", {}, 4, 9.0)], [("cpu", {}, 12, 9.0)]):
        t.append(rows(spark, *points))
    assert sorted((r["metric"], r["t_ms"], r["v"]) for r in t.samples().collect()) == [("cpu", 10, 0.5), ("cpu", 11, 2.0), ("cpu", 12, 4.0), ("disk", 5, 3.0)]
    assert given == [False, False, True]


def test_events_are_streamed_from_several_files_a_batch(spark, tmp_path, monkeypatch):
    from tempora.plans import catalog_more

    monkeypatch.setattr(catalog_more, "ROWS_AN_EVENT_FILE", 100, raising=False)
    made = iter(range(9))
    monkeypatch.setattr(catalog_more, "folder", lambda spark, name: str(tmp_path / f"{name}{next(made)}"))
    got = catalog_more._stream_monotonic(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    files = len(list(tmp_path.glob("stream*/*.parquet")))
    assert files > 3 and not files % 3
    assert len(list(tmp_path.glob("checkpoint*/commits/[0-9]*"))) == 3

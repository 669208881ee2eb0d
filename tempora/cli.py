"""Command line: add, query, time, create, info, delete, check, compact, vacuum, unlock, version."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions

import tempora
from tempora.config import load
from tempora.functions.aggregates import parse_functions
from tempora.functions.labels import parse_labels
from tempora.functions.times import format_time, parse_time, resolve_range
from tempora.plans.planner import long_form
from tempora.plans.spec import Query, product
from tempora.plans.sql import parse_select
from tempora.sources import formats, samples
from tempora.sources.schema import make_schema
from tempora.sources.table import Table


def make_query(names: str = "", functions: str = "", filter_: str = "", begin: str = "", end: str = "", last: str = "", step: str = "", window: str = "", group_by: str = "", now: int | None = None, rollups: bool = False) -> Query:
    """A query from the words of a command line; a name that begins with SELECT is SQL, and its WHERE and GROUP BY hold."""
    from tempora.functions.times import parse_duration

    if last and (begin or end):
        raise ValueError("give either last or a begin and end")
    start, stop, step_ms = resolve_range(begin, end, last, step, now)
    if names.strip().lower().startswith("select "):
        columns, _, where, groups = parse_select(names)
        return Query(start, stop, columns, step_ms, parse_duration(window), where, groups, rollups)
    if not names and not filter_:
        raise ValueError("give a metric or a filter")
    groups = [x.strip() for x in group_by.split(",") if x.strip()]
    return Query(start, stop, product(names or "*", functions), step_ms, parse_duration(window), filter_, groups, rollups)


def query_json(table: Table, request: dict, now: int | None = None) -> list:
    """The answer to {metric, aggregators, filter_expression, step, start_time, end_time, last} as JSON objects."""
    q = make_query(request.get("metric", ""), ",".join(request.get("aggregators") or []), request.get("filter_expression", ""), request.get("start_time", ""), request.get("end_time", ""), request.get("last", ""), request.get("step", ""), now=now)
    return json.loads("".join(formats.to_json(answer(table, q))))


def answer(table: Table, q: Query):  # noqa: ANN201
    from pyspark.sql import functions as F

    from tempora.plans.spec import resolved

    clamped = table.clamped(q)
    frame, checked = table.select(q), resolved(clamped)
    if not checked.columns[0].wildcard:
        if "labels" not in frame.columns:
            frame = frame.withColumn("labels", F.create_map().cast("map<string,string>")).withColumn("lset", F.lit(""))
        return long_form(frame, clamped)
    keys = [c for c in ("metric", "labels", "lset", "time") if c in frame.columns]
    values = [c for c in frame.columns if c not in (*keys, "text")]
    pairs = F.array(*[F.struct(F.lit("" if c == "value" else c).alias("aggregate"), F.col(c).cast("double").alias("value")) for c in values])
    long = frame.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").where("value IS NOT NULL")
    return long if "lset" in keys else long.withColumn("labels", F.create_map().cast("map<string,string>")).withColumn("lset", F.lit(""))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tempora")
    p.add_argument("--table", default="", help="path of the table")
    p.add_argument("--config", default="", help="JSON file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create")
    c.add_argument("-r", "--rate", default="")
    c.add_argument("-a", "--aggregates", default="")
    c.add_argument("-i", "--granularity", default="")
    c.add_argument("--cross-labels", default="")
    a = sub.add_parser("add")
    a.add_argument("metric", nargs="?", default="")
    a.add_argument("labels", nargs="?", default="")
    a.add_argument("-d", "--values", default="")
    a.add_argument("-m", "--times", default="")
    a.add_argument("-f", "--file", default="")
    a.add_argument("--json", action="store_true", help="the file has JSON lines rather than CSV")
    a.add_argument("--override", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("name", nargs="?", default="")
    for short, name in (("-b", "begin"), ("-e", "end"), ("-l", "last"), ("-i", "step"), ("-w", "window"), ("-f", "filter"), ("-a", "aggregates"), ("-g", "groupBy")):
        q.add_argument(short, f"--{name}", default="")
    q.add_argument("-o", "--output", default="", choices=["", *formats.FORMATS])
    q.add_argument("--rollups", action="store_true")
    q.add_argument("--prometheus", action="store_true", help="name aggregates' series by their metric alone, a step being a rollup bucket at most")
    i = sub.add_parser("info")
    i.add_argument("-m", "--names", action="store_true")
    i.add_argument("-n", "--count", action="store_true")
    d = sub.add_parser("delete")
    d.add_argument("metrics", nargs="*", default=[])
    for short, name in (("-b", "begin"), ("-e", "end"), ("-f", "filter")):
        d.add_argument(short, f"--{name}", default="")
    d.add_argument("-a", "--all", action="store_true")
    d.add_argument("--force", action="store_true")
    k = sub.add_parser("check")
    k.add_argument("metric")
    k.add_argument("labels", nargs="?", default="")
    sub.add_parser("compact", help="make one piece of several in each partition")
    sub.add_parser("vacuum", help="remove what writers that failed have left")
    sub.add_parser("unlock", help="break the lock of a writer that is gone")
    t = sub.add_parser("time")
    t.add_argument("value", nargs="?", default="now")
    sub.add_parser("version")
    return p


def other_time(text: str) -> str:
    """Unix seconds as RFC 3339, and anything else as Unix seconds."""
    if text.lstrip("-").isdigit():
        return format_time(int(text) * 1000)
    return str(parse_time(text) // 1000)


def main(args: list[str] | None = None, spark=None) -> int:  # noqa: ANN001
    o = parser().parse_args(args)
    if o.command == "version":
        print(f"tempora {tempora.__version__}")
        return 0
    if o.command == "time":
        print(other_time(o.value))
        return 0
    settings = load(o.config, table=o.table)
    o.table = settings.table
    if not o.table:
        raise SystemExit("give --table, or set it in the configuration or as TEMPORA_TABLE")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tempora").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "create":
        s = load(o.config, rate=o.rate, aggregates=o.aggregates, granularity=o.granularity, cross_labels=o.cross_labels)
        Table.create(spark, o.table, make_schema(s.rate, ",".join(parse_functions(s.aggregates)), s.granularity, s.cross_labels))
        return 0
    table = Table.open(spark, o.table)
    if o.command == "add":
        batch = (samples.read_json if o.json else samples.read_csv)(spark, o.file) if o.file else samples.from_arrays(spark, o.metric, o.labels, o.values, o.times)
        table.append(batch, o.override or settings.override)
    elif o.command == "query":
        asked = make_query(o.name, o.aggregates, o.filter, o.begin, o.end, o.last, o.step, o.window, o.groupBy, rollups=o.rollups)
        got = table.select_prometheus(asked).withColumn("aggregate", functions.lit("")) if o.prometheus else answer(table, asked)
        for line in formats.lines(got, o.output or settings.output):
            print(line)
    elif o.command == "compact":
        table.compact()
    elif o.command == "vacuum":
        print(f"{table.vacuum()} pieces removed")
    elif o.command == "unlock":
        table.break_lock()
    elif o.command == "info":
        print(json.dumps({k: v if isinstance(v, (str, list, int)) else v.__dict__ for k, v in table.describe(o.names, o.count).items()}, indent=1))
    elif o.command == "check":
        table.inspect(o.metric, parse_labels(o.labels)).orderBy("part_start", "chunk").show(1000, False)
    elif o.command == "delete":
        if o.all and (o.begin or o.filter):
            raise SystemExit("--all goes with neither a begin nor a filter")
        if not o.force and input("Delete? [y/N] ").strip().lower() != "y":
            return 1
        if o.all:
            table.delete_all()
        else:
            start, stop, _ = resolve_range(o.begin, o.end)
            table.delete(start, stop, o.metrics or None, o.filter)
    return 0


if __name__ == "__main__":
    sys.exit(main())

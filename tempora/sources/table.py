"""A stored table of samples: Parquet pieces by time, named by manifests that are never changed.

    _schema.json                                        the schema document
    _manifest/<number>.json                             the pieces that a version of the table has; the highest number counts
    samples/part_start=<ms>/piece=<id>/                 samples; metric and t_ms are sorted within files, so row groups can be skipped
    series/part_start=<ms>/piece=<id>/                  a row for each series of the piece, with its labels, kind and last time
    rollup/part_start=<ms>/piece=<id>/                  a row for each series and bucket of the piece
    preagg/labels=<a,b>/part_start=<ms>/piece=<id>/     rollups over a subset of the labels

A writer adds pieces that no manifest names yet and then one manifest, in a single step: whatever fails before it leaves the
table as it was, and a batch that comes again is added whole. Readers see one version from begin to end; pieces that a version
has dropped stay for the readers of the version before it. Rollup rows of a bucket may lie in several pieces; they are merged
when read. Nothing but the series is read to add samples.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.times import MINUTE, now_ms, partition_range
from tempora.operators import metadata
from tempora.operators.aggregate import merged, over_labels, rolled_up
from tempora.plans.filters import parse_filter
from tempora.plans.planner import long_form, select
from tempora.plans.spec import Query
from tempora.sources import samples as canonical
from tempora.sources.files import Files
from tempora.sources.schema import Schema

#: With overwriting on, a sample may be so much older than its series' last one.
LATE_MS = 59 * MINUTE
#: A lock that is so old was left by a writer that is gone; committing is safe without it.
STALE_MS = 6 * 60 * MINUTE
#: Samples of a file, about, and pieces of a partition from which they are made one.
ROWS_A_FILE, MAX_PIECES = 1_000_000, 40
SERIES_SCHEMA = "metric string, lset string, labels map<string,string>, numeric boolean, finite boolean, max_t long, samples long, part_start long"
ROLLUP_SCHEMA = "metric string, lset string, bucket_ms long, labels map<string,string>, count long, sum double, sqr double, max double, min double, last double, last_t long, part_start long"


def accepted(batch: DataFrame, last: DataFrame | None, override: bool = False, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The samples of a batch that a table takes.

    By default a sample must be later than all that its series (metric, lset) has in `last` (metric, lset, max_t), and of
    samples at one time the first by value stays. With `override`, samples up to LATE_MS before that are taken too and the
    one with the greatest value stands for its time. `deal` shuffles the rows by part_start and _deal, which follow from
    series and time; the rows then keep that place and are in order of the part, the series and the time.
    """
    rows = batch
    if last is not None:
        limit = F.col("max_t") - LATE_MS if override else F.col("max_t")
        rows = rows.join(last.select("metric", "lset", "max_t"), ["metric", "lset"], "left").where(F.col("max_t").isNull() | (F.col("t_ms") > limit)).select(*batch.columns)
    keys = ["metric", "lset", "t_ms"]
    if deal is not None:
        rows, keys = deal(rows), ["part_start", *keys, "_deal"]
    order = [F.col("v").asc_nulls_last(), F.col("s").asc_nulls_last()] if not override else [F.col("v").desc_nulls_last(), F.col("s").desc_nulls_last()]
    if "arrival" in batch.columns:
        order = [F.col("arrival").desc() if override else F.col("arrival").asc()]
    # the first has none before it; a rank would be looked for before the shuffle too, with a sort that few repeated times repay
    first = F.lag(F.lit(True)).over(Window.partitionBy(*keys).orderBy(*order)).isNull()
    return rows.withColumn("_first", first).where("_first").drop("_first", "_deal", "arrival")


def mixed_types(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Series (metric, lset) that would hold both numbers and text."""
    kinds = batch.select("metric", "lset", F.col("v").isNotNull().alias("numeric"))
    if known is not None:
        kinds = kinds.unionByName(known.select("metric", "lset", "numeric"))
    return kinds.groupBy("metric", "lset").agg((F.count_distinct("numeric") > 1).alias("mixed")).where("mixed").select("metric", "lset")


def series_of(samples: DataFrame) -> DataFrame:
    """A row for each series and partition of samples: labels, whether it has numbers, all of them finite, its last time and how many."""
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return samples.groupBy("part_start", "metric", "lset").agg(F.any_value("labels").alias("labels"), F.any_value(F.col("v").isNotNull()).alias("numeric"), (~F.max(F.coalesce(odd, F.lit(False)))).alias("finite"), F.max("t_ms").alias("max_t"), F.count(F.lit(1)).alias("samples"))


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: Schema) -> None:
        self.spark, self.path, self.schema, self.files = spark, path, schema, Files(spark, path)
        self.version, self.pieces = 0, {}
        self.refresh()

    # --- life of a table

    @staticmethod
    def create(spark: SparkSession, path: str, schema: Schema) -> Table:
        files = Files(spark, path)
        if not files.create_new("_schema.json", schema.to_json()):
            raise FileExistsError(f"there is a table at {path}")
        return Table(spark, path, schema)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Table:
        files = Files(spark, path)
        if not files.exists("_schema.json"):
            raise FileNotFoundError(f"there is no table at {path}")
        return Table(spark, path, Schema.from_json(files.read("_schema.json")))

    def _versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.files.names("_manifest") if x.removesuffix(".json").isdigit())

    def _pieces(self, version: int) -> dict[str, dict[int, list[str]]]:
        """kind to partition to pieces."""
        kinds = json.loads(self.files.read(f"_manifest/{version:012d}.json"))
        return {kind: {int(p): ids for p, ids in parts.items()} for kind, parts in kinds.items()}

    def refresh(self) -> None:
        """Looks at the newest version."""
        versions = self._versions()
        self.version, self.pieces = (versions[-1], self._pieces(versions[-1])) if versions else (0, {})
        self.schema.partitions = sorted(self.pieces.get("samples", {}))

    @contextmanager
    def writing(self, stale: int = STALE_MS) -> Iterator[None]:
        """Keeps other writers away; a lock older than `stale` is broken."""
        if not self.files.create_new("_lock", str(now_ms())):
            since = self.files.read("_lock").strip()
            if now_ms() - int(since or 0) < stale:
                raise RuntimeError("another writer holds the table; stop it first")
            self.break_lock()
            if not self.files.create_new("_lock", str(now_ms())):
                raise RuntimeError("another writer holds the table; stop it first")
        try:
            self.refresh()
            yield
        finally:
            self.break_lock()

    def break_lock(self) -> None:
        self.files.delete("_lock")

    def _commit(self, pieces: dict[str, dict[int, list[str]]]) -> None:
        """Makes a version of these pieces, unless another writer has made one since this one looked; then drops what the version before the last had alone."""
        pieces = {kind: kept for kind, parts in pieces.items() if (kept := {p: ids for p, ids in parts.items() if ids})}
        name, fresh = f"_manifest/{self.version + 1:012d}.json", f"_manifest/_{uuid.uuid4().hex}"
        self.files.write(fresh, json.dumps(pieces))
        if self.files.exists(name):
            self.files.delete(fresh)
            raise RuntimeError("another writer has changed the table; do it again")
        self.files.rename(fresh, name)
        before, self.version, self.pieces = self.version, self.version + 1, pieces
        self.schema.partitions = sorted(pieces.get("samples", {}))
        for old in [v for v in self._versions() if v < before]:
            self._forget(old, [self._pieces(before) if before else {}, pieces])

    def _forget(self, version: int, kept: list[dict]) -> None:
        alive = {(k, p, i) for pieces in kept for k, parts in pieces.items() for p, ids in parts.items() for i in ids}
        for kind, parts in self._pieces(version).items():
            for p, ids in parts.items():
                for i in ids:
                    if (kind, p, i) not in alive:
                        self.files.delete(f"{kind}/part_start={p}/piece={i}")
        self.files.delete(f"_manifest/{version:012d}.json")

    def vacuum(self) -> int:
        """Removes pieces that no version has, which writers that failed have left, and gives their number."""
        gone = 0
        with self.writing():
            alive = {(k, p, i) for v in self._versions() for k, parts in self._pieces(v).items() for p, ids in parts.items() for i in ids}
            for kind in self._kinds():
                for folder in self.files.folders(kind):
                    for piece in self.files.folders(f"{kind}/{folder}"):
                        if piece.startswith("piece=") and (kind, int(folder.removeprefix("part_start=")), piece.removeprefix("piece=")) not in alive:
                            self.files.delete(f"{kind}/{folder}/{piece}")
                            gone += 1
            for folder in self.files.folders("_staging"):
                self.files.delete(f"_staging/{folder}")
        return gone

    def _kinds(self) -> list[str]:
        return ["samples", "series", *(["rollup", *map(self._preagg, self.schema.label_sets)] if self.schema.aggregates else [])]

    @staticmethod
    def _preagg(labels: list[str]) -> str:
        return f"preagg/labels={'+'.join(sorted(labels))}"

    def partitions(self, name: str = "samples") -> list[int]:
        return sorted(self.pieces.get(name, {}))

    # --- reading

    def _read(self, kind: str, schema: str, start: int | None = None, stop: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows of a kind in this version; of partitions outside a time range not even the names are read."""
        held = self.pieces.get(kind, {})
        if parts is not None:
            held = {p: held[p] for p in parts if p in held}
        elif start is not None and stop is not None:
            inside = partition_range(start, max(start, stop), self.schema.partition_ms)
            held = {p: ids for p, ids in held.items() if inside[0] <= p <= inside[-1]}
        if not held:
            return self.spark.createDataFrame([], schema)
        paths = [self.files.at(f"{kind}/part_start={p}/piece={i}") for p, ids in sorted(held.items()) for i in ids]
        rows = self.spark.read.schema(schema + ", piece string").option("basePath", self.files.at(kind)).parquet(*paths).drop("piece")
        return rows.where(F.col("part_start").between(min(held), max(held)))

    def samples(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        rows = self._read("samples", canonical.SCHEMA + ", part_start long", start, stop)
        return rows if start is None else rows.where(F.col("t_ms").between(start, stop))

    def _rolled(self, kind: str, start: int | None, stop: int | None, parts: list[int] | None = None) -> DataFrame:
        """Rollup rows, one for each bucket."""
        rows = self._read(kind, ROLLUP_SCHEMA, start, stop, parts)
        if all(len(ids) == 1 for ids in self.pieces.get(kind, {}).values()):
            return rows
        length = F.lit(self.schema.partition_ms)
        return merged(rows).withColumn("part_start", F.col("bucket_ms") - F.pmod("bucket_ms", length))

    def rollups(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        return self._rolled("rollup", start, stop)

    def preaggregates(self, labels: list[str], start: int | None = None, stop: int | None = None) -> DataFrame:
        return self._rolled(self._preagg(labels), start, stop)

    def clamped(self, query: Query) -> Query:
        """The range of the query, cut to the partitions that exist; an open start becomes the first one's."""
        parts = self.schema.partitions
        if not parts:
            return query
        start, stop = max(query.start, parts[0]), min(query.stop, parts[-1] + self.schema.partition_ms - 1)
        return replace(query, start=min(start, max(stop, query.start)), stop=max(stop, query.start))

    def select(self, query: Query, clamp: bool = True, rollups: bool | None = None) -> DataFrame:
        """The answer to a query. Rollups serve it if it asks for them, or if that gives the same answer: by default, where its cells
        are made of whole buckets and all its series hold finite numbers. `rollups=False` reads samples in any case."""
        query = self.clamped(query) if clamp else query
        look_back = max([query.window, *(c.tolerance for c in query.columns), 2 * query.step])
        text, plain = self._series_kinds(query)
        stored = None
        if self.schema.aggregates and rollups is not False and (query.rollups or plain and self.whole_buckets(query)):
            exact = bool(query.group_by) and sorted(query.group_by) in self.schema.label_sets and not query.filter
            kind = self._preagg(query.group_by) if exact else "rollup"
            stored = self._read(kind, ROLLUP_SCHEMA, query.start - look_back - query.step, query.stop + query.step)
            query = replace(query, rollups=True)
        return select(self.samples(query.start - look_back, query.stop), query, text, stored, self.schema.granularity_ms)

    def whole_buckets(self, query: Query) -> bool:
        """Whether every cell of a query is made of whole rollup buckets, so that rollups answer it as samples do."""
        size = self.schema.granularity_ms
        end = self.schema.partitions and query.stop >= self.schema.partitions[-1] + self.schema.partition_ms - 1
        functions = query.kind == "cells" and all(c.base not in ("rate", "last") for c in query.columns)
        return bool(size and query.step and functions and not query.window and not query.step % size and not query.start % size and (end or not (query.stop + 1) % size))

    def select_prometheus(self, query: Query, aggregates: bool = True) -> DataFrame:
        """The answer as Prometheus wants it: metric, labels, lset, time and value, without the aggregate's name.

        A step longer than a rollup bucket becomes one bucket where rollups are stored; without `aggregates` functions are left
        out and samples come as they are.
        """
        if not aggregates:
            query = replace(query, columns=[replace(c, function="") for c in query.columns], step=0, window=0)
        elif any(c.function for c in query.columns) and self.schema.aggregates and query.step > self.schema.granularity_ms:
            query = replace(query, step=self.schema.granularity_ms)
        if any(c.wildcard for c in query.columns):
            raise ValueError("Prometheus asks for metrics by name")
        query = self.clamped(query)
        return long_form(self.select(query, clamp=False), query).drop("aggregate")

    def _series_kinds(self, query: Query) -> tuple[frozenset[str], bool]:
        """The query's own metrics that hold text, and whether all its series hold finite numbers only. One small job over the series."""
        every = any(c.wildcard for c in query.columns)
        metrics = sorted({c.metric for c in query.columns if not c.wildcard})
        functions = [c.base for c in query.columns if c.function]
        raw = [c.metric for c in query.columns if not c.wildcard and not c.function]
        if not raw and not (functions and self.schema.aggregates):
            return frozenset(), False
        rows = self._read("series", SERIES_SCHEMA)
        rows = rows if every else rows.where(F.col("metric").isin(metrics))
        odd = rows.where(~F.col("numeric") | ~F.col("finite"))
        if every:
            return frozenset(), odd.isEmpty()
        found = odd.groupBy("metric").agg((~F.min("numeric")).alias("text")).collect()  # at most the query's own metrics
        return frozenset(r["metric"] for r in found if r["text"] and r["metric"] in raw), not found

    def series(self) -> DataFrame:
        """Each series with its label map, kind, last time and number of samples; samples aren't read."""
        rows = self._read("series", SERIES_SCHEMA)
        return rows.groupBy("metric", "lset").agg(F.any_value("labels").alias("labels"), F.max("max_t").alias("max_t"), F.any_value("numeric").alias("numeric"), F.sum("samples").alias("samples"))

    def metric_names(self) -> DataFrame:
        return metadata.metric_names(self._read("series", SERIES_SCHEMA))

    def label_names(self) -> DataFrame:
        return metadata.label_names(self._read("series", SERIES_SCHEMA))

    def label_values(self, label: str) -> DataFrame:
        return metadata.label_values(self._read("series", SERIES_SCHEMA), label)

    def label_sets(self, metric: str | None = None) -> DataFrame:
        return metadata.label_sets(self._read("series", SERIES_SCHEMA), metric)

    def count_series(self) -> DataFrame:
        """How many series there are, each counted once for every partition."""
        return self._read("series", SERIES_SCHEMA).select("part_start", "metric", "lset").distinct().agg(F.count(F.lit(1)).alias("series"))

    def inspect(self, metric: str, labels: dict[str, str], start: int | None = None, stop: int | None = None) -> DataFrame:
        """Samples and their span by partition and chunk of one series."""
        from tempora.functions.labels import format_labels

        rows = self.samples(start, stop).where((F.col("metric") == metric) & (F.col("lset") == format_labels(labels)))
        chunk = (F.call_function("div", F.col("t_ms") - F.col("part_start"), F.lit(self.schema.chunk_ms)) + 1).alias("chunk")
        return rows.groupBy("part_start", chunk).agg(F.count(F.lit(1)).alias("samples"), F.min("t_ms").alias("first_t"), F.max("t_ms").alias("last_t"))

    def describe(self, names: bool = False, count: bool = False) -> dict:
        out: dict = {"path": self.path, "schema": self.schema, "partitions": self.partitions()}
        if names:
            out["metrics"] = [r[0] for r in self.metric_names().orderBy("metric").toLocalIterator()]
        if count:
            out["series"] = self.count_series().first()[0]
        return out

    def recent(self, partitions: int = 2) -> DataFrame:
        """Samples of the last partitions."""
        return self._read("samples", canonical.SCHEMA + ", part_start long", parts=self.schema.partitions[-partitions:])

    # --- writing

    def append(self, batch: DataFrame, override: bool = False) -> None:
        """Checks a batch and adds what the table accepts, with its series and rollups, or nothing at all. Bad samples and series of mixed types are an error.

        The batch is computed once; of what the table holds, only the series are read, and with `override` the partitions that
        the batch touches.
        """
        with self.writing():
            staged = self._staged(batch.select(*[c for c in batch.columns if c in (*canonical.COLUMNS, "arrival")]))
            known = self.series() if self.pieces.get("series") else None
            n, bad, mixed, late, fresh = self._looked_at(staged, known, override)
            if bad:
                bad = canonical.faults(staged).first()
                raise ValueError(f"{bad['reason']}: {bad['metric']!r} at {bad['t_ms']}")
            if mixed:
                bad = mixed_types(staged, None if known is None else known.join(staged.select("metric", "lset").distinct(), ["metric", "lset"], "left_semi")).first()
                raise ValueError(f"series {bad['metric']}{{{bad['lset']}}} holds numbers or text, not both")
            if not fresh:
                self._add(None, [])
                return
            last = known if late else None
            if not override:
                self._add(accepted(staged, last, deal=lambda rows: self._dealt(rows, n)), [])
                return
            part = F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(self.schema.partition_ms))
            rows = self._staged(accepted(staged, last, True).withColumn("part_start", part))
            touched = [r[0] for r in rows.select("part_start").distinct().toLocalIterator()]
            old = self._read("samples", canonical.SCHEMA + ", part_start long", parts=touched)
            both = rows.withColumn("arrival", F.lit(1)).unionByName(old.withColumn("arrival", F.lit(0)))
            n = both.count()
            self._add(accepted(both, None, True, lambda rows: self._dealt(rows, n)), touched)

    def _looked_at(self, staged: DataFrame, known: DataFrame | None, override: bool) -> tuple[int, ...]:
        """In one pass over a batch: its samples and those that can't be stored; its series that would be of mixed types, that have
        late samples and that have others. Only where there are late ones are the last times joined to the samples."""
        number = F.col("v").isNotNull()
        seen = staged.groupBy("metric", "lset").agg(F.count(F.lit(1)).alias("n"), F.count_if(canonical.fault().isNotNull()).alias("bad"), F.min(number).alias("all"), F.max(number).alias("any"), F.min("t_ms").alias("from_t"), F.max("t_ms").alias("to_t"))
        if known is None:
            seen = seen.select("*", F.lit(None).cast("boolean").alias("numeric"), F.lit(None).cast("long").alias("max_t"))
        else:
            seen = seen.join(known.select("metric", "lset", "numeric", "max_t"), ["metric", "lset"], "left")
        limit = F.col("max_t") - LATE_MS if override else F.col("max_t")
        mixed = (F.col("all") != F.col("any")) | (F.col("numeric") != F.col("all"))
        found = seen.agg(F.sum("n"), F.sum("bad"), F.count_if(mixed), F.count_if(F.col("from_t") <= limit), F.count_if(F.col("max_t").isNull() | (F.col("to_t") > limit))).first()
        return tuple(x or 0 for x in found)

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = self.files.at(f"_staging/{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """n rows by their partitions of the table; in each, a long series is dealt by its chunks, so that none is one task."""
        part = F.col("t_ms") - F.pmod(F.col("t_ms"), F.lit(self.schema.partition_ms))
        chunk = F.call_function("div", "t_ms", F.lit(max(1, self.schema.chunk_ms)))
        deal = F.pmod(F.xxhash64("metric", "lset", chunk), F.lit(max(1, -(-n // ROWS_A_FILE))))
        return rows.withColumn("part_start", part).withColumn("_deal", deal).repartition("part_start", "_deal")

    def _write(self, kind: str, piece: str, rows: DataFrame) -> None:
        """Adds a piece to the partitions of the rows."""
        keys = [c for c in ("metric", "lset", "t_ms", "bucket_ms") if c in rows.columns]
        rows.withColumn("piece", F.lit(piece)).sortWithinPartitions("part_start", *keys).write.mode("append").partitionBy("part_start", "piece").parquet(self.files.at(kind))

    def _add(self, rows: DataFrame | None, replaced: list[int], gone: list[int] | None = None) -> None:
        """Adds dealt samples and what follows from them as a piece, in the place of the old pieces of `replaced` partitions, without those of `gone`, and commits."""
        piece = uuid.uuid4().hex
        if rows is not None:
            self._write("samples", piece, rows)
        made = [int(x.removeprefix("part_start=")) for x in self.files.folders("samples") if self.files.exists(f"samples/{x}/piece={piece}")]
        new = {"samples": made, "series": made}
        if made:
            written = self._piece("samples", canonical.SCHEMA + ", part_start long", made, piece)
            self._write("series", piece, series_of(written))
            if self.schema.aggregates:
                part = (F.col("bucket_ms") - F.pmod(F.col("bucket_ms"), F.lit(self.schema.partition_ms))).alias("part_start")
                self._write("rollup", piece, rolled_up(written, self.schema.granularity_ms, [part]))
                new["rollup"] = self._made("rollup", made, piece)
                rolled = self._piece("rollup", ROLLUP_SCHEMA, new["rollup"], piece).drop("part_start")
                for labels in self.schema.label_sets:
                    self._write(self._preagg(labels), piece, over_labels(rolled, labels).select("*", part))
                    new[self._preagg(labels)] = self._made(self._preagg(labels), made, piece)
        out = {}
        for kind in self._kinds():
            out[kind] = {p: [] if p in replaced or p in (gone or []) else list(ids) for p, ids in self.pieces.get(kind, {}).items()}
            for p in new.get(kind, []):
                out[kind].setdefault(p, []).append(piece)
        self._commit(out)
        self.files.delete("_staging")
        if crowded := [p for p, ids in self.pieces.get("samples", {}).items() if len(ids) >= MAX_PIECES]:
            self._compact(crowded)

    def _made(self, kind: str, parts: list[int], piece: str) -> list[int]:
        return [p for p in parts if self.files.exists(f"{kind}/part_start={p}/piece={piece}")]

    def _piece(self, kind: str, schema: str, parts: list[int], piece: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        paths = [self.files.at(f"{kind}/part_start={p}/piece={piece}") for p in parts]
        return self.spark.read.schema(schema + ", piece string").option("basePath", self.files.at(kind)).parquet(*paths).drop("piece")

    def _compact(self, parts: list[int]) -> None:
        rows = self._read("samples", canonical.SCHEMA + ", part_start long", parts=parts)
        self._add(self._dealt(rows, rows.count()).drop("_deal"), parts)

    def compact(self) -> None:
        """Makes one piece of several in each partition."""
        with self.writing():
            if parts := [p for p, ids in self.pieces.get("samples", {}).items() if len(ids) > 1]:
                self._compact(parts)

    def delete_all(self) -> None:
        with self.writing():
            self.files.delete("")

    def delete(self, start: int = 0, stop: int | None = None, metrics: list[str] | None = None, filter: str = "") -> None:  # noqa: A002
        """Removes the samples from start to stop, both included, of the metrics and the filter if given.

        A partition that is removed whole isn't read; others are written again without the samples, with their rollups, and the
        version that has them replaces the old one in one step. The last time of a series follows from what is left.
        """
        stop = now_ms() if stop is None else stop
        condition = F.col("t_ms").between(start, stop)
        if metrics:
            condition = condition & F.col("metric").isin(metrics)
        if (own := parse_filter(filter)) is not None:
            condition = condition & own
        with self.writing():
            length = self.schema.partition_ms
            inside = [p for p in self.schema.partitions if p + length - 1 >= start and p <= stop]
            whole = [p for p in inside if start <= p and p + length - 1 <= stop and not metrics and not filter]
            rows = self._read("samples", canonical.SCHEMA + ", part_start long", parts=[p for p in inside if p not in whole])
            hit = [r[0] for r in rows.where(condition).select("part_start").distinct().toLocalIterator()]
            if hit or whole:
                rows = self._read("samples", canonical.SCHEMA + ", part_start long", parts=hit).where(~F.coalesce(condition, F.lit(False)))
                self._add(self._dealt(rows, rows.count()).drop("_deal") if hit else None, hit, whole)


__all__ = ["Table", "accepted", "merged", "mixed_types"]

"""N-gram Jaccard join and its components, as a join in the metric space of word-shingle sets.

The distance 1 - Jaccard is a metric. Between unrelated texts it is 1, or nearly so, and no pivot drawn from such a space tells
one half from the other; so regions start from pivots that are near by construction, and every bound below is exact.

1. Equal sets are one point. Shingles are dealt by hash to see which ones two or more points hold; one that many points of a
   worker hold is frequent, and only that goes where it belongs, while the points keep it, so no task gets all of its points. Points lie near the set of all shingles that two or more points hold, or they have no neighbour: a
   neighbour within radius r shares at least (1 - r) of a point's shingles. Points further off leave (`_shared`).
2. A point looks for neighbours under its rarest shingles only: two points within r share at least one of the first
   n - ceil((1 - r) n) + 1 in any common order. Each such shingle has a pivot, the least of its points; a pivot's region is all
   points that share such a shingle with it. Two neighbours share a shingle, so they share its pivot's region, and the distances
   of both to the pivot are known (`_distances`).
3. Within a region, points within r of the pivot are linked through it. A point x further off, at the boundary, can only have
   neighbours y with |d(x, pivot) - d(y, pivot)| <= r: the window that the triangle inequality leaves.
   A region with more than LEAF_ITEMS in boundary points and their windows is divided (`_divided`): pivots drawn from its boundary
   points, a Voronoi cell for each, in which a boundary point has its home with its nearest pivot p and from which every point y
   is also copied to the cell of a pivot q with d(y, q) <= d(y, p) + 2 r, as a neighbour of a point at home there may be no
   further off. A point linked to the pivot at its home stays one that looks for neighbours there: it may link to a copied point
   that isn't, and neither may be at the boundary anywhere else. Only what is known to be connected already isn't compared.
   Cells are regions like the first ones, and are divided again while that makes them smaller.
   Regions that are small enough, or that pivots no longer divide, are joined exactly, in blocks of bounded size (`_boundary`).
4. Links that connect points make components; a component's id is its least doc_id (`components`).
5. All links are asked for apart (`links`): every two points of a region, blockwise, but for those that the triangle inequality
   tells apart. Two neighbours share a region, so none is lost; the work grows with the square of a region, as links may.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import WORD, forget, map_arrow, own_cache, written

WORDS = 5
#: Two documents link when 100 times their shared shingles are at least so many times all their shingles.
PERCENT = 80
#: Hashes that a worker gathers before it deals them out, and set elements of a block of the boundary join.
_AT_ONCE, BLOCK_ITEMS = 2_000_000, 100_000
#: Set elements up to which a region isn't divided, pivots that divide one, the share of a region that its largest cell must stay
#: below for the division to count, and how often regions are divided at most; what is left is joined in blocks.
LEAF_ITEMS, PIVOTS, SMALLER, LEVELS = 400_000, 8, 0.7, 6
#: A shingle that so many points have among those that a worker gathers is a frequent one.
FREQUENT, ALL_FREQUENT = 16, 65535
COUNTERS = 1 << 21
#: Points of a block of the join that finds all links.
BLOCK_POINTS = 400
_CACHE = 300_000
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_WORDS = _Words()
own_cache("jaccard", _WORDS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P[1]
    h = (h ^ (h >> np.uint64(27))) * _P[2]
    return h ^ (h >> np.uint64(31))


def shingles(utf8: bytes, n: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct n-word shingles, ascending; of the whole sequence where it is shorter; none without words."""
    words = utf8.lower().split()  # lower() and split() of bytes know A to Z, the space and the controls 9 to 13 only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = len(h) - n + 1
    out = _mixed(h[:m])
    for j in range(1, n):
        out = _mixed(out * _P[0] + h[j : m + j])
    return np.unique(out)


def point(s: np.ndarray) -> int:
    """The id of a set."""
    return int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True)


def _blob(points: np.ndarray, sizes: np.ndarray, counts: np.ndarray, *items: np.ndarray) -> bytes:
    return np.array([len(points), counts.sum()], "<u4").tobytes() + points.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + b"".join(x.tobytes() for x in items)


def _unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    """points and sizes, repeated for each item, then the items."""
    n, m = map(int, np.frombuffer(data, "<u4", 2))
    points, sizes, counts = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n), np.frombuffer(data, "<u4", n, 8 + 12 * n)
    out, at = [np.repeat(points, counts), np.repeat(sizes, counts)], 8 + 16 * n
    for k in kinds:
        out.append(np.frombuffer(data, k, m, at))
        at += out[-1].nbytes
    return out


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(sorted_[1:] != sorted_[:-1])[0] + 1]) if len(sorted_) else np.zeros(0, np.int64)


def _grouped(bucket: np.ndarray, points: np.ndarray, sizes: np.ndarray, *items: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob for each bucket."""
    if not len(bucket):
        return
    order = np.lexsort((points, bucket))
    bucket, points, sizes, items = bucket[order], points[order], sizes[order], tuple(x[order] for x in items)
    at = _starts(bucket)
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        s = _starts(points[a:b])
        yield int(bucket[a]), _blob(points[a:b][s], sizes[a:b][s], np.diff([*s, b - a]), *(x[a:b] for x in items))


#: kind 0: a document, with its point, the size of its set and a hash of its text; kind 1: shingles by point; kind 2: a point with
#: its shared shingles; kind 3: frequent shingles by point; kind 4: shingles that are frequent somewhere.
_ROW = "bucket long, kind int, blob binary, doc_id long, n long, point long, tie long"
_NAMES = ("bucket", "kind", "blob", "doc_id", "n", "point", "tie")
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=list(_NAMES))


def text_hash() -> F.Column:
    """A hash of the text; a null one is empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _shared(docs: DataFrame, percent: int, n_words: int) -> DataFrame:
    """A row for each document (kind 0) and one for each point that can have a neighbour (kind 2), with its shared shingles from the rarest on."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        points, found, n, place = [], [], 0, 0

        def dealt() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in found], np.int64)
            h, own, n = np.concatenate(found), np.repeat(np.array(points, np.int64), sizes), np.repeat(sizes, sizes)
            # counted by some bits of the hash: one that shares them with a frequent one counts as frequent too, which loses nothing
            slot = (h & np.uint64(COUNTERS - 1)).astype(np.int64)
            often = np.bincount(slot, minlength=COUNTERS)[slot] >= FREQUENT
            buckets = (h % np.uint64(parts)).astype(np.int64)
            yield _rows([(b, 1, blob, None, None, None, None) for b, blob in _grouped(buckets[~often], own[~often], n[~often], h[~often])])
            # frequent shingles go straight to their points; where the others of them go, it is told that they are frequent
            yield _rows([(b, 3, blob, None, None, None, None) for b, blob in _grouped((own[often] % parts).astype(np.int64), own[often], n[often], h[often])])
            told = np.unique(h[often])
            told = told[np.argsort(told % np.uint64(parts), kind="stable")]
            to = (told % np.uint64(parts)).astype(np.int64)
            at = _starts(to)
            yield _rows([(int(to[a]), 4, told[a:b].tobytes(), None, None, None, None) for a, b in zip(at, [*at[1:], len(to)][: len(at)], strict=True)])

        for b in batches:
            rows = []
            for doc, text, tie in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = shingles(text.as_py() or b"", n_words)
                p = point(s) if len(s) else None
                rows.append((place % parts, 0, None, doc, len(s), p, tie))  # needed nowhere in particular
                place += 1
                if p is not None and p not in known:
                    known.add(p)
                    points.append(p)
                    found.append(s)
                    n += len(s)
                    if n >= _AT_ONCE:
                        yield from dealt()
                        points, found, n = [], [], 0
            yield _rows(rows)
        if n:
            yield from dealt()

    def passed(b: pa.RecordBatch, *kinds: int) -> pa.RecordBatch:
        return b.filter(pa.compute.is_in(b.column(1), pa.array(kinds, pa.int32())))

    def blobs(b: pa.RecordBatch, kind: int) -> list[bytes]:
        return passed(b, kind).column(2).to_pylist()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all shingles dealt here, those of two points or more, dealt by point, with how many points have each, but one number for all that are frequent anywhere."""
        got, told = [], [np.zeros(0, "<u8")]
        for b in batches:
            yield passed(b, 0, 3)
            got += [_unblob(x, "<u8") for x in blobs(b, 1)]
            told += [np.frombuffer(x, "<u8") for x in blobs(b, 4)]
        if not got:
            return
        points, sizes, h = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(h, kind="stable")
        h, points, sizes = h[order], points[order], sizes[order]
        at = _starts(h)
        length = np.diff([*at, len(h)])
        frequent = np.isin(h[at], np.unique(np.concatenate(told)))
        many = np.repeat(frequent | (np.maximum.reduceat(points, at) != np.minimum.reduceat(points, at)), length)
        rank = np.repeat(np.where(frequent, ALL_FREQUENT, np.minimum(length, ALL_FREQUENT - 1)), length).astype("<u2")[many]
        h, points, sizes = h[many], points[many], sizes[many]
        rows = [(b, 1, blob, None, None, None, None) for b, blob in _grouped((points % parts).astype(np.int64), points, sizes, h, rank)]
        for i in range(0, len(rows), 200):
            yield _rows(rows[i : i + 200])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Points that share enough of their shingles."""
        got = []
        for b in batches:
            yield passed(b, 0)
            got += [_unblob(x, "<u8", "<u2") for x in blobs(b, 1)]
            got += [[*x, np.full(len(x[0]), ALL_FREQUENT, "<u2")] for x in (_unblob(x, "<u8") for x in blobs(b, 3))]
        if not got:
            return
        points, sizes, h, rank = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((h, rank, points))
        points, sizes, h = points[order], sizes[order], h[order]
        # a point that several workers have dealt has each shingle as often
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (points[1:] != points[:-1])
        points, sizes, h = points[once], sizes[once], h[once]
        at, rows = _starts(points), []
        for a, b in zip(at, [*at[1:], len(points)], strict=True):
            if 100 * (b - a) >= percent * int(sizes[a]):
                rows.append((None, 2, h[a:b].tobytes(), None, int(sizes[a]), int(points[a]), None))
                if len(rows) == 200:
                    yield _rows(rows)
                    rows = []
        yield _rows(rows)

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), text_hash().alias("tie"))
    first = map_arrow(columns, sets, _ROW, "jaccard")
    # a bucket is a partition: hashed once more, several would meet in one task
    to_bucket = lambda df: df.repartitionById(parts, F.col("bucket").cast("int"))
    second = map_arrow(to_bucket(first), often, _ROW, "jaccard")
    return written(map_arrow(to_bucket(second), near, _ROW, "jaccard"), "jaccard-points")


def _keys(points: DataFrame, percent: int) -> DataFrame:
    """point and key: the shingles under which a point looks for neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for p, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = np.frombuffer(s.as_py(), "<i8")
                keys.append(h[: len(h) - -(-percent * n // 100) + 1])
                ids.append(np.full(len(keys[-1]), p, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["point", "key"])

    return map_arrow(points.select("point", "n", "items"), run, "point long, key long", "jaccard")


def shared_items(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _distances(points: DataFrame, percent: int) -> DataFrame:
    """point, pivot, n, n_pivot and shared (shingles of both), a row for each pivot whose region has the point."""
    keys = _keys(points, percent)
    pivots = keys.groupBy("key").agg(F.min("point").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "pivot")
    pairs = keys.join(pivots, "key").where("point <> pivot").select("point", "pivot").distinct()
    as_pivot = points.select(F.col("point").alias("pivot"), F.col("n").alias("n_pivot"), F.col("items").alias("pivot_items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = [shared_items(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(b.column(4), b.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(shared, pa.int64())], names=["point", "pivot", "n", "n_pivot", "shared"])

    both = pairs.join(points, "point").join(as_pivot, "pivot").select("point", "pivot", "n", "n_pivot", "items", "pivot_items")
    return written(map_arrow(both, run, "point long, pivot long, n long, n_pivot long, shared long", "jaccard"), "jaccard-distances")


def _linked(percent: int) -> F.Column:
    return 100 * F.col("shared") >= percent * (F.col("n") + F.col("n_pivot") - F.col("shared"))


def block_links(own: list[int], items: list[np.ndarray], n: np.ndarray, d: np.ndarray, edge: np.ndarray, pivot: int, percent: int, home: np.ndarray | None = None, anchor: list[int | None] | None = None) -> list[tuple[int, int]]:
    """Links within a block that connect what isn't connected yet.

    own: points; items: their shared shingles; n: sizes of their whole sets; d: distances to the region's pivot; edge: those that
    are to be joined with the others; home: those that are so in this block or in another one of the region (without it: edge);
    anchor: a point that each is known to be connected to, or None. Points within the radius of the pivot are connected already.
    """
    radius = 1 - percent / 100
    home = edge if home is None else home
    sizes = np.array([len(s) for s in items])
    flat = np.unique(np.concatenate(items), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
    root = np.arange(len(own) + 1)  # the last one is the pivot

    def join(i: int, j: int) -> None:
        if root[i] != root[j]:
            root[root == root[j]] = root[i]

    root[:-1][d <= radius + 1e-12] = len(own)
    place: dict[int, int] = {pivot: len(own)}
    for i, (p, q) in enumerate(zip(own, anchor or [None] * len(own), strict=True)):  # a point may come twice, once to be joined with and once to join
        join(place.setdefault(p, i), i)
        if q is not None:
            join(place.setdefault(q, i), i)
    out = []
    for i in np.nonzero(edge)[0]:
        open_ = (root[:-1] != root[i]) & (np.abs(d - d[i]) <= radius + 1e-9)
        if root[i] == root[-1]:
            open_ &= ~home  # those at home look for this one themselves, unless they are connected to the pivot too
        if not open_.any():
            continue
        mark[flat[at[i] : at[i + 1]]] = True
        shared = np.add.reduceat(mark[flat], at[:-1].clip(max=max(0, len(flat) - 1)), dtype=np.int64) if len(flat) else np.zeros(len(own), np.int64)
        mark[flat[at[i] : at[i + 1]]] = False
        near = open_ & (100 * shared >= percent * (n + n[i] - shared))
        for j in np.nonzero(near)[0]:
            if root[i] != root[j]:
                join(i, j)
                out.append((own[i], own[j]))
    return out


def _regions(far: DataFrame, percent: int) -> DataFrame:
    """The regions with something to join: region, foreign (points that are neither at home here nor linked to the pivot, but may be neighbours of linked ones), the least distance of a point that seeks (`_seeks`), and the set elements of those and of all that may be their neighbours."""
    radius = 1 - percent / 100
    far_off = F.col("d") > radius + 1e-12
    foreign = far.groupBy("region").agg(F.count_if(~F.col("edge") & far_off & (F.col("d") <= 2 * radius + 1e-9)).alias("foreign"), *[
        f.alias(name + end) for end, seeks in (("", F.col("edge")), ("_off", F.col("edge") & far_off))
        for name, f in (("least", F.min(F.when(seeks, F.col("d")))), ("most", F.max(F.when(~seeks, F.col("d")))), ("edges", F.count_if(seeks)), ("edge_items", F.sum(F.when(seeks, F.col("n")))))
    ], F.sum("n").alias("all_items"))
    regions = foreign.select("region", "foreign", "all_items", *[F.when(F.col("foreign") > 0, F.col(x)).otherwise(F.col(f"{x}_off")).alias(x) for x in ("least", "most", "edges", "edge_items")])
    # one point that seeks with nothing in its window has no neighbour here
    return regions.where((F.col("edges") > 1) | (F.col("edges") == 1) & (F.col("most") >= F.col("least") - radius - 1e-9))


def _seeks(percent: int) -> F.Column:
    """Whether a row of `far`, with its region's `foreign`, is to be joined with the others: one that is linked to the pivot needs none but foreign ones."""
    return F.col("edge") & ((F.col("d") > 1 - percent / 100 + 1e-12) | (F.col("foreign") > 0))


def _divided(points: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The Voronoi cells of regions (rows of `far`), as rows of `far`, with `linked` where a point is within the radius of the cell's pivot.

    Every link of a point with `edge` to a point of its region is one to a pivot or one of its home cell, where it keeps `edge`. A
    pivot has all of its links at once. `anchor` is a point that a point is known to be connected to.
    """
    radius = 1 - percent / 100
    items = points.select("point", F.col("items").alias("own_items"))
    first = Window.partitionBy("region").orderBy(F.col("d") <= radius + 1e-12, F.xxhash64("point"), "point")  # the pivot's own links divide least
    drawn = large.where("edge").withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS).select("region", "point", "n", "anchor")
    drawn = drawn.join(items, "point")
    pivots = drawn.groupBy("region").agg(F.collect_list(F.struct("point", "n", "anchor", F.col("own_items").alias("items"))).alias("pivots"))  # PIVOTS at most
    both = large.select("region", "point", "n", "edge", "anchor").join(items, "point").join(pivots, "region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for region, point, n, edge, anchor, own, of in zip(*(b.column(k).to_pylist() for k in ("region", "point", "n", "edge", "anchor")), b.column("own_items"), b.column("pivots").to_pylist(), strict=True):
                mine = np.frombuffer(own.as_py(), "<u8")
                met = sorted(of, key=lambda q: q["point"])
                shared = [n if q["point"] == point else shared_items(mine, np.frombuffer(q["items"], "<u8")) for q in met]
                d = [1 - k / (n + q["n"] - k) for k, q in zip(shared, met, strict=True)]
                home = min(range(len(d)), key=d.__getitem__)
                for j, q in enumerate(met):
                    if d[j] <= d[home] + 2 * radius + 1e-9:
                        linked = 100 * shared[j] >= percent * (n + q["n"] - shared[j])
                        known = anchor
                        if linked and anchor is None:
                            known = q["point"] if q["anchor"] is None else q["anchor"]
                        rows.append((xxhash.xxh64_intdigest(f"{region}:{q['point']}") - (1 << 63), q["point"], point, n, d[j], bool(edge and j == home and q["point"] != point), known, bool(linked), region))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["region", "pivot", "point", "n", "d", "edge", "anchor", "linked", "parent"])

    columns = both.select("region", "point", "n", "edge", "anchor", "own_items", "pivots")
    return written(map_arrow(columns, run, "region long, pivot long, point long, n long, d double, edge boolean, anchor long, linked boolean, parent long", "jaccard"), "jaccard-cells")


def _boundary(points: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links a, b of boundary points within their windows, enough of them to connect what is connected."""
    distance = 1 - F.col("shared") / (F.col("n") + F.col("n_pivot") - F.col("shared"))
    far = found.select(F.col("pivot").alias("region"), "pivot", "point", "n", distance.alias("d"), (~_linked(percent)).alias("edge"), F.when(_linked(percent), F.col("pivot")).alias("anchor"))
    links = []
    for _ in range(LEVELS):
        regions = _regions(far, percent)
        large = written(regions.where(F.col("all_items") > LEAF_ITEMS).select("region", "foreign", "all_items"), "jaccard-large")
        if large.isEmpty():
            break
        cells = _divided(points, far.join(large.select("region", "foreign"), "region").withColumn("edge", _seeks(percent)).drop("foreign"), percent)
        links.append(cells.where("linked AND point <> pivot").select(F.col("point").alias("a"), F.col("pivot").alias("b")))
        largest = _regions(cells, percent).join(cells.select("region", "parent").distinct(), "region").groupBy(F.col("parent").alias("region")).agg(F.max("all_items").alias("cell_items"))
        smaller = written(large.join(largest, "region", "left").where(F.coalesce("cell_items", F.lit(0)) < SMALLER * F.col("all_items")).select("region"), "jaccard-smaller")
        # what pivots don't divide stays as it is and is joined in blocks; cells of the others are the regions of the next turn
        stuck = far.join(large.select("region").join(smaller, "region", "left_anti"), "region")
        links.append(_in_blocks(points, stuck, percent))
        rest = far.join(large.select("region"), "region", "left_anti")
        far = rest.unionByName(cells.join(smaller.withColumnRenamed("region", "parent"), "parent").select(*rest.columns))
    links.append(_in_blocks(points, far, percent))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _in_blocks(points: DataFrame, far: DataFrame, percent: int) -> DataFrame:
    """Links a, b of the points of regions that seek, within their windows, block by block."""
    radius = 1 - percent / 100
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ITEMS).cast("int")
    regions = _regions(far, percent).select("region", "least", "foreign", blocks("all_items").alias("rows_"), blocks("edge_items").alias("edges_"))
    sized = far.join(regions, "region").withColumn("edge", _seeks(percent)).where(F.col("edge") | (F.col("d") >= F.col("least") - radius - 1e-9)).select("region", "pivot", "point", "n", "d", "edge", "anchor", "rows_", "edges_")
    # a point stands in one block of rows, against each block of edges; one that seeks also in one block of edges, against each of rows
    mine = lambda c: F.pmod(F.xxhash64("point"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_row = sized.select("region", "pivot", "point", "n", "d", F.lit(False).alias("edge"), F.col("edge").alias("home"), "anchor", mine("rows_").alias("i"), F.explode(every("edges_")).alias("j"))
    as_edge = sized.where("edge").select("region", "pivot", "point", "n", "d", "edge", F.col("edge").alias("home"), "anchor", F.explode(every("rows_")).alias("i"), mine("edges_").alias("j"))
    rows = as_row.unionByName(as_edge).join(points.select("point", "items"), "point")

    def run(table: pa.Table) -> pa.Table:
        items = [np.frombuffer(x.as_py(), "<u8") for x in table["items"]]
        edge, home = (table[k].to_numpy(zero_copy_only=False) for k in ("edge", "home"))
        found = block_links(table["point"].to_pylist(), items, table["n"].to_numpy(), table["d"].to_numpy(), edge, table["pivot"][0].as_py(), percent, home, table["anchor"].to_pylist())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("region", "i", "j").applyInArrow(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for all ends of the links a, b.

    Stars are made larger and smaller in turn until nothing changes; each turn takes minima before anything is shuffled and
    joins them back, and is written to the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "jaccard-edges")
    before = None
    while True:
        # each node sends its larger neighbours to the least node that it knows
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # each node sends itself and its smaller neighbours to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        old, edges = edges, written(small, "jaccard-edges")
        forget(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _clean(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(docs: DataFrame, percent: int = PERCENT, n_words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links, its own included) for each row of docs.

    Two documents link when 100 * |a and b| >= percent * |a or b| for their sets of distinct n_words-word shingles, A-Z in lower
    case; a document of fewer words is one shingle. Null texts and texts without words have no shingles and link with nothing.
    Repeated rows and equal texts are one point and come back one by one; a null doc_id is never a component's id unless its
    component has no other; other columns are ignored; an empty table gives no rows. Sets are told apart by 64-bit hashes.
    """
    members, ids = _solved(docs, percent, n_words)
    return members.join(ids.select("point", "component_id"), "point", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _solved(docs: DataFrame, percent: int, n_words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, point and tie (a hash of the text) of each row of docs; and point, component_id and first (no id, doc_id and tie of the component's first row) of each point."""
    spark = docs.sparkSession
    rows = _shared(docs, percent, n_words)
    _clean(spark)
    members = rows.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "point", "tie")
    points = rows.where("kind = 2").select("point", "n", F.col("blob").alias("items"))
    found = _distances(points, percent)
    _clean(spark)
    links = found.where(_linked(percent)).select(F.col("point").alias("a"), F.col("pivot").alias("b")).unionByName(_boundary(points, found, percent))
    roots = connected(links)
    _clean(spark)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    own = members.where("point IS NOT NULL").groupBy("point").agg(F.min("doc_id").alias("least"), F.min(place).alias("first"))
    rooted = own.join(roots, own["point"] == roots["node"], "left").select("point", "least", "first", F.coalesce("root", "point").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return members, written(rooted.select("point", "root").join(of_root, "root").select("point", "component_id", "first"), "jaccard-components")


def pair_links(own: np.ndarray, items: list[np.ndarray], n: np.ndarray, d: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """All links between the points of a block, or of two blocks where there are two; d: distances to one pivot."""
    radius = 1 - percent / 100
    order = np.argsort(block, kind="stable")
    own, items, n, d, block = own[order], [items[i] for i in order], n[order], d[order], block[order]
    last = int(np.searchsorted(block, block[0], side="right"))
    two = last < len(own)
    sizes = np.array([len(x) for x in items])
    flat = np.unique(np.concatenate(items), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark, out = np.zeros(int(flat.max()) + 1, bool), []
    for i in range(last if two else len(own) - 1):
        k = last if two else i + 1
        mark[flat[at[i] : at[i + 1]]] = True
        shared = np.add.reduceat(mark[flat[at[k] :]], at[k:-1] - at[k], dtype=np.int64)
        mark[flat[at[i] : at[i + 1]]] = False
        near = (np.abs(d[k:] - d[i]) <= radius + 1e-9) & (100 * shared >= percent * (n[k:] + n[i] - shared))
        out += [(int(own[i]), int(x)) for x in own[k:][near]]
    return out


def _all_links(points: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Every pair a < b of points that link, once."""
    far = found.withColumn("d", 1 - F.col("shared") / (F.col("n") + F.col("n_pivot") - F.col("shared")))
    regions = far.groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all_items")).where("k > 1")
    regions = regions.select("pivot", F.greatest(F.ceil(F.col("k") / BLOCK_POINTS), F.ceil(F.col("all_items") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    sized = far.join(regions, "pivot").withColumn("m", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    # a point stands once with each block, its own included
    met = sized.select("pivot", "point", "n", "d", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    rows = met.select("pivot", "point", "n", "d", "m", F.least("m", "x").alias("i"), F.greatest("m", "x").alias("j")).join(points.select("point", "items"), "point")

    def run(table: pa.Table) -> pa.Table:
        block, i, j = table["m"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        pairs = []
        if i == j or len(set(block.tolist())) == 2:
            pairs = pair_links(table["point"].to_numpy(), [np.frombuffer(x.as_py(), "<u8") for x in table["items"]], table["n"].to_numpy(), table["d"].to_numpy(), block, percent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    within = rows.groupBy("pivot", "i", "j").applyInArrow(run, "a long, b long")
    both = found.where(_linked(percent)).select(F.col("point").alias("a"), F.col("pivot").alias("b")).unionByName(within)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, percent: int = PERCENT, n_words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """All links: doc_id, n_shingles and point of each row of docs, and every pair a < b of points that link.

    Rows link if their points are equal and not null, or a pair. What links is as in `components`.
    """
    rows = _shared(docs, percent, n_words)
    members = rows.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "point")
    points = rows.where("kind = 2").select("point", "n", F.col("blob").alias("items"))
    found = _distances(points, percent)
    _clean(docs.sparkSession)
    return members, written(_all_links(points, found, percent), "jaccard-links")


def link_counts(docs: DataFrame, percent: int = PERCENT, n_words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and n_links, with how many other rows of docs, copies included, each row of docs links."""
    members, pairs = links(docs, percent, n_words)
    held = members.where("point IS NOT NULL").groupBy("point").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(held.withColumnRenamed("point", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    counts = held.join(others, held["point"] == others["a"], "left").select("point", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(counts, "point", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, percent: int = PERCENT, n_words: int = WORDS) -> DataFrame:
    """One row of docs for each component, with docs' own columns, whatever their names.

    The row with the least doc_id stays, rows without an id come last, and of those that share it the one with the least hash of
    its text; of rows equal in id and text the first by their other columns as JSON. So texts are judged, not ids: different texts
    under one id stay both unless they link, and copies without an id go. Rows without words, null or empty ones too, link with
    nothing and all stay. An empty table gives no rows.
    """
    _, ids = _solved(docs, percent, n_words)
    first = written(ids.select("first.unnamed", "first.doc_id", "first.tie").distinct().select(F.col("unnamed").alias("unnamed_"), F.coalesce("doc_id", F.lit(0)).alias("id_"), F.col("tie").alias("tie_")), "jaccard-kept")
    _clean(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.rlike(WORD).alias("words"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), text_hash().alias("tie"))
    # texts are dealt by id and hash once, at every size; the join leaves them in order of these, which the window takes as it is
    named = rows.where("words").join(first.hint("merge"), (F.col("unnamed") == F.col("unnamed_")) & (F.col("id") == F.col("id_")) & (F.col("tie") == F.col("tie_")))
    others = F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != "text"]))
    one = named.withColumn("place", F.row_number().over(Window.partitionBy("unnamed", "id", "tie").orderBy(others))).where("place = 1")
    return one.select("row.*").unionByName(rows.where("NOT words").select("row.*"))


_PAIRS = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)
"""
ORACLE = f"""
WITH RECURSIVE {_PAIRS},
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""
LINKS_ORACLE = f"""
WITH {_PAIRS}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links
FROM sets s LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) c ON s.doc_id = c.a
"""

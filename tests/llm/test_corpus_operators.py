"""The operators over whole tables, against brute force."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import jaccard, mixing, packing, quality, queries, secrets, simhash
from tempora.llm.common import written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_shingles long, size string, bits string, k long, kind string"


def table(spark, texts, sources=None, repeat=True, null_id=True):
    """Texts as a table with columns that share names with results, a row that comes twice and a null id."""
    rows = [(i, t, sources[i] if sources else None, 1, "x", "y", 3, "z") for i, t in enumerate(texts)]
    more = ([rows[-1]] if repeat and rows else []) + ([(None, "one two three four five six", "s", None, None, None, None, None)] if null_id else [])
    return spark.createDataFrame([*rows, *more], SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def variants(seed=3, groups=12):
    """Texts in groups of near copies, chains of copies whose ends don't link, shared passages and odd ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(30))
    out = [None, "", " \t", "One two", "one TWO", "a b c d e", "A b c d e", "É b c d e", "é b c d e"]
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            if rnd.random() < 0.5:
                base = own  # the next one is a copy of the copy
            out.append("  ".join(own).upper() if rnd.random() < 0.3 else " ".join(own))
        out.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 60))) + " " + passage)
    rnd.shuffle(out)
    return out


def brute_sets(texts):
    found = []
    for t in texts:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        found.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return found


def brute_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(spark, seed):
    texts = variants(seed)
    sets = brute_sets(texts)
    want = brute_components(sets)
    rows = jaccard.components(table(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        else:
            assert (r["n_shingles"], r["component_id"]) == (2, None)


def test_jaccard_boundary_in_blocks(spark, monkeypatch):
    """Chains that link only at the edge of regions, in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_ITEMS", 150)
    rnd = random.Random(9)
    text, texts = [f"t{i}" for i in range(60)], []
    for i in range(60):
        texts.append(" ".join(text))
        text[rnd.randrange(60)] = f"n{i}"
    sets = brute_sets(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(table(spark, texts, repeat=False, null_id=False)).collect()}
    assert [got[i] for i in range(60)] == brute_components(sets)


@pytest.mark.parametrize(("leaf", "pivots"), [(1, 2), (600, 3), (2500, 8)])
def test_jaccard_regions_are_divided(spark, monkeypatch, leaf, pivots):
    """Regions that pivots divide once or more, and one that they don't, against brute force."""
    monkeypatch.setattr(jaccard, "BLOCK_ITEMS", 500)
    monkeypatch.setattr(jaccard, "LEAF_ITEMS", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rnd, texts, turns = random.Random(12), [], []
    # families that share a passage and so a region, near copies in each, and a chain from one to the next
    passage = " ".join(f"p{i}" for i in range(12))
    for f in range(7):
        own = [f"f{f}w{i}" for i in range(60)]
        for _ in range(9):
            text = list(own)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
            texts.append(passage + " " + " ".join(text))
    text = texts[0].split()
    for i in range(30):
        text[12 + rnd.randrange(60)] = f"n{i}"
        texts.append(" ".join(text))
    divided = jaccard._divided
    monkeypatch.setattr(jaccard, "_divided", lambda *a: (turns.append(1), divided(*a))[1])
    sets = brute_sets(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(table(spark, texts, repeat=False, null_id=False)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(sets)
    assert 1 <= len(turns) <= jaccard.LEVELS or leaf == 2500


def stretches(rnd):
    """Sets of which the first links to the second, that to the third and that to the fourth, and a far set, the first one here, as a pivot."""
    return [set(range(k, k + 100)) for k in (90, 0, 10, 20, 30)]


def walks(rnd):
    """Sets that branch off from one another by up to seven items."""
    found = [list(range(60))]
    for i in range(40):
        own = list(rnd.choice(found[-6:]))
        for j in range(rnd.randint(1, 7)):
            own[rnd.randrange(60)] = 1000 + 10 * i + j if rnd.random() < 0.6 else rnd.randrange(100, 140)
        found.append(own)
    out = list({frozenset(x) for x in found})
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("family", "smaller", "leaf", "pivots", "block"), [(stretches, 0.7, 1, 2, 100_000), (walks, 2, 1, 3, 200), (walks, 2, 600, 2, 100_000)])
def test_jaccard_links_over_edges_of_cells(spark, monkeypatch, family, smaller, leaf, pivots, block):
    """Two points, each linked to the pivot of its own cell, whose link alone connects the cells; divided once and, with smaller at 2, again and again."""
    monkeypatch.setattr(jaccard, "SMALLER", smaller)
    monkeypatch.setattr(jaccard, "LEAF_ITEMS", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "BLOCK_ITEMS", block)
    rnd, points, found, sets = random.Random(1), [], [], []
    for region in range(24 if family is stretches else 8):
        own = [{10_000 * region + x for x in s} for s in family(rnd)]
        ids = [rnd.getrandbits(62) for _ in own]
        sets += own
        points += [(p, len(s), bytearray(np.array(sorted(s), "<u8").tobytes())) for p, s in zip(ids, own, strict=True)]
        found += [(p, ids[0], len(s), len(own[0]), len(s & own[0])) for p, s in zip(ids[1:], own[1:], strict=True)]
    links = jaccard._boundary(spark.createDataFrame(points, "point long, n long, items binary"), spark.createDataFrame(found, "point long, pivot long, n long, n_pivot long, shared long"), 80).collect()
    place, root = {p: i for i, (p, _, _) in enumerate(points)}, list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*((place[r["a"]], place[r["b"]]) for r in links), *((place[p], place[q]) for p, q, n, m, k in found if 100 * k >= 80 * (n + m - k))]:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert [find(i) for i in range(len(points))] == brute_components(sets)


@pytest.mark.parametrize("block", [3, 400])
def test_jaccard_links(spark, monkeypatch, block):
    """Every link of groups of near copies, whatever the blocks, and copies counted."""
    monkeypatch.setattr(jaccard, "BLOCK_POINTS", block)
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    texts = [*variants(6, 6), *(" ".join(w if j != 3 * i else "new" for j, w in enumerate(base)) for i in range(25)), " ".join(base), " ".join(base)]
    rnd.shuffle(texts)
    sets = brute_sets(texts)
    like = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = [0] * len(sets)
    for a, b in like:
        want[a], want[b] = want[a] + 1, want[b] + 1
    docs = table(spark, texts, repeat=False, null_id=False)
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"]) for r in jaccard.link_counts(docs).collect()}
    assert got == {i: (len(x), n) for i, (x, n) in enumerate(zip(sets, want, strict=True))}
    members, pairs = jaccard.links(docs)
    point = {r["doc_id"]: r["point"] for r in members.collect()}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == {tuple(sorted((point[a], point[b]))) for a, b in like if point[a] != point[b]}
    assert jaccard.link_counts(table(spark, [], null_id=False)).count() == 0


def test_jaccard_edges(spark):
    empty = table(spark, [], null_id=False)
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    alone = table(spark, ["a b c", None], repeat=False, null_id=False)
    assert sorted(tuple(r) for r in jaccard.components(alone).collect()) == [(0, 1, 0), (1, 0, 1)]
    hot = table(spark, ["x y z a b c d"] * 300 + ["x y z a b c e"], repeat=False)
    got = jaccard.components(hot)
    assert got.where("component_id = 0").count() == 300


def test_keep_one(spark):
    texts = variants(5)
    want = {i for i, c in enumerate(brute_components(brute_sets(texts))) if c == i}
    kept = jaccard.keep_one(table(spark, texts))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


@pytest.mark.parametrize(("frequent", "at_once"), [(2, 300), (4, 2_000), (3, 10**6)])
def test_jaccard_frequent_shingles(spark, monkeypatch, frequent, at_once):
    """Shingles that are frequent in some workers' batches and rare in others."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "_AT_ONCE", at_once)
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << (8 if at_once == 300 else 21))  # so few that rare shingles count as frequent
    rnd = random.Random(frequent)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [*variants(5, 6), *(f"{common} " + " ".join(f"u{rnd.randrange(3)}" if rnd.random() < 0.1 else f"t{j}" for j in range(40)) for _ in range(40)), *(common + f" r{i} s{i} t{i}" for i in range(20)), common, common]
    rnd.shuffle(texts)
    sets = brute_sets(texts)
    docs = table(spark, texts, repeat=False, null_id=False).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(sets)
    like = sum(1 for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    points = {frozenset(x) for x in sets if x}
    pairs = sum(1 for i, a in enumerate(points) for b in list(points)[:i] if 100 * len(a & b) >= 80 * len(a | b))
    assert jaccard.links(docs)[1].count() == pairs <= like


def test_keep_one_judges_texts_not_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a), (None, a), (None, "x " + b + " tail end"), (None, "x " + b + " tail end"), (3, b.upper()), (4, None), (4, None), (5, " \n"), (None, ""), (6, a), (6, a)]
    docs = spark.createDataFrame([(i, t, "k", 1, 2, "p", i, i) for i, t in rows], "doc_id long, text string, _kept string, _row int, place int, tie string, unnamed long, id_ long").repartition(4)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs).collect()), key=str)
    wordless = [(4, None), (4, None), (5, " \n"), (None, "")]
    assert kept == sorted([(1, a), (1, b), (None, "x " + b + " tail end"), *wordless], key=str)
    assert jaccard.keep_one(docs).columns == docs.columns and {r["_kept"] for r in jaccard.keep_one(docs).collect()} == {"k"}
    many = spark.createDataFrame([(7, a, i % 3) for i in range(500)] + [(None, b, i) for i in range(500)], "doc_id long, text string, place int").repartition(6)
    assert sorted(((r["doc_id"], r["place"]) for r in jaccard.keep_one(many).collect()), key=str) == [(7, 0), (None, 0)]


def test_block_links():
    rnd = np.random.default_rng(2)
    base = np.arange(40, dtype=np.uint64)
    items = [np.sort(np.concatenate([np.delete(base, rnd.integers(0, 40, rnd.integers(0, 9))), rnd.integers(100, 10**9, rnd.integers(0, 6), np.uint64)])) for _ in range(30)]
    items = [np.unique(x) for x in items]
    n = np.array([len(x) for x in items])
    d = np.array([1 - len(np.intersect1d(x, base)) / len(np.union1d(x, base)) for x in items])
    links = jaccard.block_links(list(range(30)), items, n, d, d > 0.2, -1, 80)
    sets = [{int(v) for v in x} for x in [*items, base]]
    want = brute_components(sets)
    root = list(range(31))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*links, *((i, 30) for i in range(30) if d[i] <= 0.2)]:
        root[find(a)] = find(b)
        assert {a, b} & {30} or len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])
    groups = lambda f: sorted(sorted(i for i in range(31) if f(i) == g) for g in {f(i) for i in range(31)})
    assert groups(find) == groups(lambda i: want[i])


def test_block_links_of_points_connected_to_the_pivot():
    """A point that is connected to the pivot, by distance or through another one, still meets those that don't look for it themselves."""
    items = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 10, 20, 20, 30)]
    n, d = np.full(5, 100), np.array([1 - (100 - k) / (100 + k) for k in (0, 10, 20, 20, 30)])
    edge, abroad = np.array([False, True, True, False, False]), np.array([False, True, True, True, False])
    own = [7, 8, 9, 9, 10]
    pairs = lambda *a: sorted(tuple(sorted(x)) for x in jaccard.block_links(own, items, n, d, edge, 7, 80, *a))
    assert pairs(abroad) == [(8, 9), (9, 10)]
    assert pairs(abroad, [None, None, 8, 8, None]) == [(9, 10)]
    assert pairs(abroad, [None, 5, 5, 5, 5]) == []
    # one that is at home elsewhere in the region, and so looks itself, is left to do so
    assert pairs(np.array([False, True, True, True, True]), [None, None, 8, 8, None]) == []


def test_connected(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for ab in links for x in ab}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in jaccard.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    for i in root:
        assert got.get(i, i) == find(i)


def brute_mix(docs):
    """Targets by taking turns, as the contract words it."""
    size, total = {}, 0
    for s, t in docs:
        size[s] = size.get(s, 0) + len(words(t))
        total += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, stopped = 1.5 * total, {}
    while True:
        free = [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            return size, stopped | {s: level * weight[s] for s in free}
        for s in over:
            stopped[s] = 2 * size[s]
            left -= 2 * size[s]


def test_mixing(spark):
    rnd = random.Random(8)
    names = ["b", "a", "é", "Z", None, "c", "d", "e"]
    sources = [rnd.choices(names, [40, 9, 3, 5, 6, 1, 1, 1])[0] for _ in range(600)]
    texts = [None if i % 50 == 0 else " ".join("w" for _ in range(rnd.randint(0, 40))) for i in range(600)]
    docs = table(spark, texts, sources, repeat=False, null_id=False)
    size, target = brute_mix(list(zip(sources, texts, strict=True)))
    taken = {}
    rows = mixing.digest(mixing.copies(docs)).collect()
    assert len(rows) == 600
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["size"] * math.floor(target[s] / max(size[s], 1)) <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert abs(taken["b"] / target["b"] - 1) < 0.15
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.digest(mixing.copies(docs.repartition(5))).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r["doc_id"]: c for r in mixing.copies(docs).collect() if (c := r["copies"])}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.copies(table(spark, [None, ""])).agg(F.sum("size")).first()[0] == 6


def test_mixing_without_ids(spark):
    """Rows without an id are drawn one by one and meet the source's target together."""
    rows = [(None, f"{i} " + "w " * (i % 30), "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame([*rows, *[(i, "w " * (i % 30), "a") for i in range(1500)]], "doc_id long, text string, source string").repartition(4)
    got = mixing.copies(docs)
    for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05, r
    parts = {r["source"]: r["kinds"] for r in got.where("doc_id IS NULL").groupBy("source").agg(F.countDistinct("copies").alias("kinds")).collect()}
    assert 2 in parts.values()


def test_mixing_repeated_rows(spark, monkeypatch):
    """A row that makes most of a source is drawn for each of its copies; columns may be named like those used inside."""
    monkeypatch.setattr(mixing, "STRETCH", 70)
    rows = [(7, "w w w", "a", 1, "x")] * 1500 + [(None, "v v v v", "a", 2, None)] * 800 + [(i, "u u", "b", 3, "y") for i in range(900)] + [(i, None, None, None, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _rate string").repartition(5)
    got = mixing.copies(docs)
    assert got.count() == len(rows) and got.where("doc_id = 7 AND source = 'a'").select("copies").distinct().count() == 2
    for r in got.where("size > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.05, r
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("_rate = 'y' AND copies = 3").count() == got.where("source = 'b'").agg(F.sum("copies")).first()[0]
    assert sorted(map(tuple, mixing.digest(got).collect()), key=str) == sorted(map(tuple, mixing.digest(mixing.copies(docs.coalesce(1))).collect()), key=str)


def spark_hash(*longs):
    h = 42
    for x in longs:
        h = h if x is None else xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
    return h


def brute_fingerprint(text):
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    terms = [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [spark_hash(*w)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(t >> b & 1 for t in terms) > len(terms))


def test_fingerprints(spark):
    texts = variants(6) + ["ümlaut straße " * 9, "😀 " * 30]
    rows = simhash.edits(table(spark, texts)).collect()
    order = [(None, "one two three four five six"), *enumerate(t or "" for t in texts)]
    nxt = {doc: order[(i + 1) % len(order)][1] for i, (doc, _) in enumerate(order)}
    assert len(rows) == len(texts) + 2
    near = lambda a, b: max(0.0, math.cos(math.pi * bin(a ^ b).count("1") / 64))
    for r in rows:
        text = dict(order)[r["doc_id"]]
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[r["doc_id"]][:q]
        a, b, c = map(brute_fingerprint, (text, edited, nxt[r["doc_id"]]))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (int(r["fingerprint"], 16), int(r["edited_fingerprint"], 16)) == (a, b)
        assert r["near_edited"] == pytest.approx(near(a, b)) and r["near_next"] == pytest.approx(near(a, c))
    assert simhash.edits(table(spark, [], null_id=False)).count() == 0
    alone = simhash.edits(table(spark, ["a b c d e f g h"], repeat=False, null_id=False)).first()
    assert alone["near_next"] == 1.0


def test_near_fingerprints(spark):
    rnd = random.Random(1)
    bits = [rnd.getrandbits(64) for _ in range(40)]
    for b in list(bits):
        for k in (1, 2, 3, 4, 6):
            bits.append(b ^ sum(1 << i for i in rnd.sample(range(64), k)))
    signed = sorted({b - (1 << 64) if b >> 63 else b for b in bits})
    found = spark.createDataFrame([(b,) for b in [*signed, *signed[:9], None]], "bits long")
    for radius in (1, 3):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        got = [(r["a"], r["b"]) for r in simhash.near_pairs(found, radius).collect()]
        assert set(got) == want and len(got) == len(want)


def test_near_search(spark):
    """All near fingerprints of the documents that are asked for, of texts that differ by little, against brute force."""
    rnd, texts = random.Random(3), []
    for i in range(40):
        base = [f"w{i}x{j}" for j in range(400)]
        for _ in range(6):
            text = list(base)
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(400)] = "other"
            texts.append(" ".join(text))
    docs = table(spark, [*texts, None, ""])
    rows = simhash.search(docs, 4).collect()
    bits = {brute_fingerprint(t) for t in [*texts, "", "no id here"]}
    given = {i: brute_fingerprint(t or "") for i, t in enumerate([*texts, None, ""])}
    asked = sorted([i for i in given if i % 4 == 0] + ([241] if 241 % 4 == 0 else []))
    assert sorted(r["doc_id"] for r in rows) == asked
    for r in rows:
        own = given[r["doc_id"]]
        near = [n for b in bits if b != own and (n := (own ^ b).bit_count()) <= simhash.RADIUS]
        assert (int(r["fingerprint"], 16), r["n_near"], r["nearest"]) == (own, len(near), min(near, default=None))
    assert sum(r["n_near"] for r in rows) > 40
    assert simhash.search(docs.limit(0)).count() == 0


def test_native_plans(spark):
    for name in ("op7_simhash", "op7_near", "op10_mixing"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Rows without an id, repeated ids and rows, null and empty texts; and an empty table."""
    good = [" ".join(f"{'alpha beta gamma delta'.split()[(i * 7 + j) % 4]}{i}x{j}" for j in range(120)) for i in range(12)]
    rows = [(None, good[0], "a"), (None, good[0], "a"), (1, good[0], "a"), (2, good[1], None), (2, good[2], "b"), (3, None, "b"), (4, "", None), (5, good[3] + " password=hunter2hunter2", "c"), *[(6, good[4], "c")] * 5, *[(10 + i, good[5 + i], "a") for i in range(6)]]
    frame = spark.createDataFrame([(i, t, "en", src, None if t is None else len(t)) for i, t, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs in (("odd", frame), ("empty", frame.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept = []
        docs = queries.read_documents(spark, f"{tmp_path}/{name}")
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, f"{tmp_path}/{name}"), "test-stage")
            kept.append(docs.collect())
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == len(kept[-1])
        if name == "empty":
            assert not any(kept)
            continue
        assert len(kept[0]) == len(rows) - 2
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept[1]) == sorted((str(i), t) for i, t in [(1, good[0]), (2, good[1]), (2, good[2]), (5, rows[7][1]), (6, good[4]), *[(10 + i, good[5 + i]) for i in range(6)]])
        assert not any("hunter2" in r["text"] for r in kept[2]) and len(kept[2]) == len(kept[1])
        counts = {}
        for r in kept[3]:
            counts[r["doc_id"], r["text"]] = counts.get((r["doc_id"], r["text"]), 0) + 1
        assert max(counts.values()) <= 2 and set(counts) <= {(r["doc_id"], r["text"]) for r in kept[2]}


def test_fingerprints_of_one_row_many_times(spark):
    docs = spark.createDataFrame([(1, "the same words again and again")] * 3000 + [(2, "other words")], "doc_id long, text string").repartition(5)
    rows = simhash.edits(docs).groupBy("doc_id", "fingerprint", "near_next").count().collect()
    assert sorted((r["doc_id"], r["count"]) for r in rows) == [(1, 3000), (2, 1)]
    assert simhash.search(docs, 1).count() == 3001


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "source mixing", "packing"]
    docs = queries.read_documents(spark, SF)
    columns, given = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-stage")
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    ids = [[r["doc_id"] for r in d.collect()] for d in kept[:-1]]
    good = sorted(i for i, r in given.items() if quality.measure((r["text"] or "").encode())["kept"])
    assert sorted(ids[0]) == good
    components = brute_components(brute_sets([given[i]["text"] for i in good]))
    first = [i for j, i in enumerate(good) if components[j] == j]
    assert sorted(ids[1]) == first
    hidden = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert hidden == {i: secrets.hidden(given[i]["text"].encode()).decode() for i in first}
    counts = {r["doc_id"]: r["copies"] for r in mixing.copies(kept[2]).collect()}
    assert sorted(ids[3]) == sorted(i for i, c in counts.items() for _ in range(c))
    tokens = {}
    for r in kept[4].collect():
        assert len(r["ids"]) == 4 * r["length"]
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    whole = packing.pack(kept[3], queries.public_tokenizers.path(queries.WORD_BPE)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert tokens == {r["doc_id"]: r["n"] for r in whole}
    assert corpus_pipeline.run(spark, SF).count() > 0

"""SimHash document fingerprints and the search for near ones, in DataFrame operations only.

A text's terms are its shingles of five words; each term's hash votes on 64 signed bits, once for each time the term occurs, so
terms weigh by frequency. A bit of the fingerprint is set where the votes are positive. The votes are summed as 32 long columns
of two 32-bit counters each, in one hash aggregation. Near fingerprints are found through tables of permuted blocks: 64 bits in
radius + SPARE blocks, of which two fingerprints within the radius must share SPARE whole ones.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import written

WORDS_A_TERM = 5
BITS = 64
RADIUS, SPARE = 3, 3
#: Rows whose ids are divisible by this are searched for.
SEARCHED = 20
#: The last so much of a text is replaced in the edited text of the query.
EDITED_PART = 4


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words of a text, in order."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def term_hashes(h: Column, n: int = WORDS_A_TERM) -> Column:
    """Structs of n neighbouring word hashes; a text of fewer words is one term, with null for what is missing; none without words."""
    windows = F.arrays_zip(*[F.slice(h, i + 1, F.greatest(F.size(h) - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)])
    short = F.array(F.struct(*[F.get(h, F.lit(i)).alias(f"w{i}") for i in range(n)]))
    return F.when(F.size(h) >= n, windows).when(F.size(h) > 0, short)


def votes(term: Column) -> list[Column]:
    """Sums whose low and high halves count the terms that set bit k and bit k + 32."""
    return [F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit((1 << 32) | 1))).alias(f"v{k}") for k in range(32)]


def fingerprint_bits(n_terms: Column) -> Column:
    """The fingerprint as a long: a bit is set if more than half of the terms set it."""
    low = (1 << 32) - 1
    bits = F.lit(0).cast("long")
    for k in range(32):
        v = F.coalesce(F.col(f"v{k}"), F.lit(0).cast("long"))
        for count, bit in ((v.bitwiseAND(F.lit(low)), k), (F.shiftrightunsigned(v, 32), k + 32)):
            bits = bits.bitwiseOR(F.when(count * 2 > n_terms, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return bits


def spelled(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the angle that the share of different bits stands for: 1 for equal fingerprints, 0 from half of the bits on."""
    return F.greatest(F.lit(0.0), F.when(distance(a, b) == 0, 1.0).otherwise(F.cos(distance(a, b) * F.lit(3.141592653589793 / BITS))))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and `bits`, a row for each row of texts if the keys are unique; rows that share all keys vote together.

    Null and empty texts have no terms and the fingerprint 0. If texts come partitioned by keys, nothing is shuffled; else one
    row for each key and task is, after summing where the text was read.
    """
    # the generators keep the word hashes from being computed again for each term
    hashed = texts.select(*keys, F.explode(F.array(word_hashes(F.coalesce(F.col(text), F.lit("")))))).withColumnRenamed("col", "_h")
    terms = hashed.select(*keys, F.explode_outer(term_hashes(F.col("_h"))).alias("_t"))
    term = F.when(F.col("_t").isNotNull(), F.xxhash64(*[F.col("_t").getField(f"w{i}") for i in range(WORDS_A_TERM)]))
    summed = terms.select(*keys, term.alias("_s")).groupBy(*keys).agg(*votes(F.col("_s")), F.count("_s").alias("_n"))
    return summed.select(*keys, fingerprint_bits(F.col("_n")).alias("bits"))


def order(ids: DataFrame, partitions: int) -> DataFrame:
    """ids with next_doc, next_tie and room_before: the next row's keys (after the last, the first's) and the n_chars of the row before.

    ids has doc_id, tie and n_chars and no row twice. Rows are dealt by ranges of doc_id, and neighbours are looked up within a
    range; what crosses an edge comes from one row for each range.
    """
    dealt = written(ids.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "tie").withColumn("part", F.spark_partition_id()), "fingerprint-order")
    by = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    key = F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "tie", "n_chars")
    edges = dealt.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts, ends = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(ends)).alias("after"), F.coalesce(F.lag("last").over(parts), F.last("last").over(ends)).alias("before"))
    own = dealt.withColumn("_next", F.lead(key).over(by)).withColumn("_last", F.lag(key).over(by)).join(F.broadcast(edges), "part")  # a row for each of `partitions` ranges
    after, before = F.coalesce("_next", "after"), F.coalesce("_last", "before")
    return own.select("doc_id", "tie", "n_chars", "repeats", after["doc_id"].alias("next_doc"), after["tie"].alias("next_tie"), before["doc_id"].alias("last_doc"), before["tie"].alias("last_tie"), before["n_chars"].alias("room_before"))


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are to these and to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document by
    doc_id. Null texts are empty. Rows equal in doc_id and text are one document in that order and are returned as often as they
    come; texts that share a doc_id follow each other by a hash; a null doc_id comes first; after the last document comes the
    first; a single document is its own next. Other columns are ignored; an empty table gives no rows.

    Each text is shuffled once, by its keys, and the part that its neighbour needs once more. Equal rows vote together, which
    leaves every bit as one of them sets it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull()))
    ids = texts.groupBy("doc_id", "tie", F.char_length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("repeats"))
    placed = written(order(ids, int(spark.conf.get("spark.sql.shuffle.partitions"))), "fingerprint-places")
    keyed = texts.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), "tie", "text")
    if not placed.where("repeats > 1").isEmpty():
        keyed = keyed.dropDuplicates(["k", "tie"])  # equal rows are made one before their texts are moved
    places = placed.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("k"), "tie", "doc_id", "n_chars", "repeats", F.coalesce("next_doc", F.lit(0)).cast("long").alias("next_k"), "next_tie", F.coalesce("last_doc", F.lit(0)).cast("long").alias("last_k"), "last_tie", "room_before")
    here = keyed.join(places, ["k", "tie"])
    part = lambda n: F.floor(n / EDITED_PART).cast("int")
    given = here.select(F.col("last_k").alias("k"), F.col("last_tie").alias("tie"), F.substring(F.col("text"), F.lit(1), part(F.col("room_before"))).alias("given")).groupBy("k", "tie").agg(F.first("given").alias("given"))
    both = here.join(given, ["k", "tie"])
    changed = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - part(F.col("n_chars"))).cast("int")), F.col("given"))
    versions = both.select("k", "tie", "doc_id", "n_chars", "repeats", "next_k", "next_tie", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("kind"), changed.alias("text"), F.sha2(changed, 256).alias("sha")))).alias("x"))
    keys = ["k", "tie", "doc_id", "n_chars", "repeats", "next_k", "next_tie", "kind", "sha"]
    found = fingerprints(versions.select(*keys[:-2], "x.kind", "x.sha", "x.text"), keys)
    two = found.groupBy(*keys[:-2]).agg(F.max(F.when(F.col("kind") == 0, F.col("bits"))).alias("bits"), F.max(F.when(F.col("kind") == 1, F.col("bits"))).alias("edited_bits"), F.max("sha").alias("edited_sha256"))
    two = written(two, "fingerprints")
    after = two.select(F.col("k").alias("next_k"), F.col("tie").alias("next_tie"), F.col("bits").alias("next_bits"))
    return two.join(after, ["next_k", "next_tie"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("bits")).alias("fingerprint"), spelled(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks of nearly equal size."""
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _in_tables(bits: DataFrame, name: str, masks: list[int]) -> DataFrame:
    """Each fingerprint in each table, under the blocks that the table keeps."""
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return bits.select(F.col("bits").alias(name), F.explode(tables).alias("t")).select(name, "t.table", "t.key")


def _met(wanted: DataFrame, found: DataFrame, radius: int, spare: int) -> DataFrame:
    """Pairs a of wanted and b of found (the long column `bits`, no value twice) at most `radius` bits apart, each once, and their distance."""
    masks = [sum(((1 << n) - 1) << a for a, n in chosen) for chosen in combinations(_blocks(radius + spare), spare)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    first = F.array_position(F.array(*[F.col("a").bitwiseAND(F.lit(m)) == F.col("b").bitwiseAND(F.lit(m)) for m in signed]), True) - 1
    pairs = _in_tables(wanted, "a", signed).join(_in_tables(found, "b", signed), ["table", "key"]).where(distance(F.col("a"), F.col("b")) <= radius)
    return pairs.where(first == F.col("table")).select("a", "b", distance(F.col("a"), F.col("b")).alias("distance"))


def near_pairs(found: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """All pairs a < b of different fingerprints (the long column `bits`) at most `radius` bits apart, and their distance.

    Fingerprints of equal texts and of other equal votes are one row here, so copies, however many, make no pairs; null ones are
    left out. Each fingerprint has a row in each of C(radius + spare, spare) tables, keyed by `spare` of the blocks; a pair counts
    in the first table that has it, so none comes twice. A key's rows meet in a join that may be split where it is skewed.
    """
    distinct = found.select("bits").where("bits IS NOT NULL").distinct()
    return _met(distinct, distinct, radius, spare).where("a < b")


def near_to(wanted: DataFrame, found: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """For each fingerprint of wanted all others of found at most `radius` bits apart: a, b and their distance; both have a long column `bits`.

    Equal fingerprints are one row, as in `near_pairs`, and aren't near themselves; null ones are left out; empty tables give none.
    """
    own = [df.select("bits").where("bits IS NOT NULL").distinct() for df in (wanted, found)]
    return _met(*own, radius, spare).where("a <> b")


def search(docs: DataFrame, every: int = SEARCHED, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """doc_id, fingerprint, n_near and nearest for each row of docs whose id is divisible by `every`: how many other fingerprints all rows of docs have within the radius, and how far off the nearest of them is (null without one).

    Rows equal in id and text come as often as they are there; null texts are empty; a null id isn't searched for but found;
    other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    counted = texts.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("repeats"))
    # rows equal in id and text vote together, which leaves every bit as one of them sets it
    found = written(fingerprints(texts, ["doc_id", "tie"]).join(counted.withColumnsRenamed({"doc_id": "own_id", "tie": "own_tie"}), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie"))).select("doc_id", "bits", "repeats"), "fingerprints")
    asked = found.where(F.col("doc_id") % every == 0)
    near = near_to(asked, found, radius, spare).groupBy(F.col("a").alias("bits")).agg(F.count(F.lit(1)).alias("n_near"), F.min("distance").alias("nearest"))
    rows = asked.join(near, "bits", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return rows.select("doc_id", spelled(F.col("bits")).alias("fingerprint"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("nearest").cast("int").alias("nearest"))

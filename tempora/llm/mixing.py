"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed by source, a target and a repetition rate follow for each source, and each document is emitted floor(rate)
times plus one more time if a draw seeded by its id, source and text falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import WORD, written

#: Weights of the sources by code point, null last, over and over.
WEIGHTS = (5, 2, 1)
#: What all sources share, in percent of all tokens, and where a source's target stops, in times its own tokens.
SHARE_PERCENT, MOST = 150, 2
SEED = "mix"
#: Rows of a group of equal ones that a task numbers.
STRETCH = 1000


def token_size() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sized: DataFrame) -> DataFrame:
    """source, source_size, target and rate, one row for each source, of rows with source and size.

    A target that would pass MOST times its source's size stops there and the excess goes to the others by weight, until none is
    above: with sources in order of size per weight, the first ones stop, and one level times the weight holds for the rest.
    The windows run over one row for each source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = (
        ranked.withColumn("weight", weight)
        .withColumn("given", F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0).cast("long")))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long")))
        .withColumn("level", (F.sum("source_size").over(whole) * SHARE_PERCENT / 100.0 - F.col("given")) / F.col("weights_left"))
        .withColumn("stops", F.col("level") * F.col("weight") >= F.col("source_size") * MOST)
    )
    level = F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank"))).over(whole)
    target = F.when(F.col("stops"), (F.col("source_size") * MOST).cast("double")).otherwise(level * F.col("weight"))
    return rated.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def draw(seed: str, doc_id: F.Column, source: F.Column, text: F.Column, occurrence: F.Column | None = None) -> F.Column:
    """A number in [0, 1) that depends on the seed, doc_id, source and text, and on which of the rows equal in these it is: 52 bits of a hash."""
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.lit(f"{seed}:"), text_of(doc_id), F.lit(":"), F.coalesce(F.md5(source.cast("string")), F.lit("")), F.lit(":"), F.md5(text_of(text))]
    if occurrence is not None:
        parts.append(F.when(occurrence > 0, F.concat(F.lit(":"), occurrence.cast("string"))).otherwise(""))
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with `occurrence`: 0 for a row that has no equal, and 0, 1, 2, ... for equal ones.

    Rows of repeated keys are counted, before anything is shuffled, and written out again in stretches, so that no task gets more
    than STRETCH of a group however large it is.
    """
    same = (rows["key"] == repeated["key_"]) & rows["source"].eqNullSafe(repeated["source_"]) & (rows["size"] == repeated["size_"])
    once = rows.join(repeated, same, "left_anti").withColumn("occurrence", F.lit(0).cast("long"))
    equal = rows.join(repeated, same, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    stretches = equal.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long")))).repartition("key", "first")
    own = stretches.withColumn("occurrence", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + STRETCH, F.col("n")) - 1)))
    return once.unionByName(own.select(*once.columns))


def _counted(docs: DataFrame, seed: str) -> DataFrame:
    """row (all columns of docs), size, source_size, target and copies. Names of docs can't clash with those used here."""
    none = lambda c: F.col(c).isNull()
    key = F.xxhash64("doc_id", none("doc_id"), "text", none("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), token_size().alias("size"), key.alias("key"))
    # one row for each document, of numbers and the source; equal rows are one
    counted = written(rows.groupBy("source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    rates = written(source_rates(counted.select("source", (F.col("size") * F.col("n")).alias("size"))), "mix-rates")
    repeated = counted.where("n > 1").select(F.col("key").alias("key_"), F.col("source").alias("source_"), F.col("size").alias("size_"))
    occurrence = None
    if not repeated.isEmpty():
        rows, occurrence = _numbered(rows, repeated), F.col("occurrence")
    named = rates.select(F.col("source").alias("source_"), "source_size", "target", "rate")
    joined = rows.join(named, rows["source"].eqNullSafe(named["source_"]), "left")
    whole = F.floor("rate")
    drawn = draw(seed, F.col("row")["doc_id"], F.col("row")["source"], F.col("row")["text"], occurrence)
    return joined.select("row", "size", "source_size", "target", (whole + (drawn < F.col("rate") - whole).cast("long")).alias("copies"))


def copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix emits the row).

    Null and empty texts have size 0. A null source is a source of its own, the last. Rows without an id, and rows that share one,
    draw by their texts and sources; rows equal in all three draw one by one, by a number that each has among them, so a source
    that is mostly one repeated row still meets its target. Other columns stay as they are, but for those named like the added
    ones, which are replaced. An empty table gives no rows. The rates are summed before anything is shuffled, and a source's rows
    are never brought together: the join is by source against one row each, small enough to be broadcast or split where it is
    skewed.
    """
    added = ("size", "source_size", "target", "copies")
    counted = _counted(docs, seed)
    return counted.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' own columns, whatever their names.

    Nulls, empty texts, repeated rows and empty tables as in `copies`; a row whose text is null or empty weighs nothing and comes
    as often as its source's rate says.
    """
    taken = _counted(docs, seed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select("row.*")


def digest(counted: DataFrame) -> DataFrame:
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = """
WITH sized AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(source), '') || ':' || md5(coalesce(text, ''))
  || CASE WHEN row_number() OVER same > 1 THEN ':' || (row_number() OVER same - 1) ELSE '' END AS seed, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\x0C\\r]+')), 0) AS size FROM documents WINDOW same AS (PARTITION BY doc_id, source, text)),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per),
rated AS (
  SELECT *, source_size / weight AS room,
    (sum(source_size) OVER () * 150 / 100.0 - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM weighed),
stopped AS (SELECT *, level * weight >= 2 * source_size AS stops FROM rated),
targets AS (SELECT source, source_size, CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT arg_min(level, room * 1000 + rank) FROM stopped WHERE NOT stops) END AS target FROM stopped),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.source_size, r.target,
  CAST(d.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || d.seed), 1, 13) AS BIGINT) / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""

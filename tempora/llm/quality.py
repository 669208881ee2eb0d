"""Quality rules by repetition coverage.

A document's words are numbered, rolling hashes of several n-gram lengths run over the numbers in numpy, and a word counts as
covered at a length if it lies in an n-gram that the document holds twice or more. The rules bound the share of characters that
covered words and duplicated lines make up, besides the base counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import map_arrow

MIN_WORDS = 50
#: Percent of the words that may lie in repeated windows of BASE_N words.
MAX_REPEAT_PERCENT, BASE_N = 50, 3
#: Largest share of the word characters inside duplicated n-grams, by n.
MAX_NGRAM_SHARE = {5: 0.30, 7: 0.28, 10: 0.25}
#: Largest share of the characters of lines with a word that lie in lines found twice or more.
MAX_LINE_SHARE = 0.30
#: Largest number of symbols for each word.
MAX_SYMBOLS_A_WORD = 0.25
SYMBOLS = b"#*$%&|<>"
#: The base hash multiplies by an odd number, so that all 64 bits of a number stay in use.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_chars": pa.int64(), "line_chars": pa.int64(), **{f"dup_chars_{n}": pa.int64() for n in MAX_NGRAM_SHARE}}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in MAX_NGRAM_SHARE)


def n_chars(utf8: bytes) -> int:
    return len(utf8) if utf8.isascii() else len(utf8.decode())


def covered(ids: np.ndarray, n: int) -> np.ndarray | None:
    """Which words lie in an n-gram found twice or more; None if there is none."""
    m = len(ids) - n + 1
    if m < 2:
        return None
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * _STEP + ids[j : m + j] * _MIX
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(m + n, np.int64)
    edge[:m] += twice
    edge[n:] -= twice
    return np.cumsum(edge)[: len(ids)] > 0


def measure(utf8: bytes) -> dict:
    """All counts of one text, given in UTF-8, and the verdict."""
    words = utf8.split()  # at the space and the controls 9 to 13, like WORD
    n = len(words)
    lines: dict[bytes, int] = {}
    line_chars = dup_line_chars = n_dup_lines = 0
    ascii_ = utf8.isascii()
    if n:
        for line in utf8.split(b"\n"):
            if line.strip():
                lines[line] = lines.get(line, 0) + 1
        for line, k in lines.items():
            chars = len(line) if ascii_ else n_chars(line)
            line_chars += chars * k
            if k > 1:
                n_dup_lines += k - 1
                dup_line_chars += chars * k
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    word_chars = sum(map(len, words)) if ascii_ else len(b"".join(words).decode())
    sizes = None
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": sum(utf8.count(c) for c in SYMBOLS), "n_dup_lines": n_dup_lines, "dup_line_chars": dup_line_chars, "line_chars": line_chars}
    cover = covered(ids, BASE_N)
    out["n_repeat_words"] = 0 if cover is None else int(cover.sum())
    for k in MAX_NGRAM_SHARE:
        cover = cover if cover is None else covered(ids, k)  # a repeated long n-gram holds a repeated short one
        if cover is not None and sizes is None:
            sizes = np.fromiter(map(len, words) if ascii_ else map(n_chars, words), np.int64, n)
        out[f"dup_chars_{k}"] = 0 if cover is None else int(sizes[cover].sum())
    out["base_failed"] = n < MIN_WORDS or 100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n
    out["kept"] = not out["base_failed"] and dup_line_chars <= MAX_LINE_SHARE * line_chars and out["n_symbols"] <= MAX_SYMBOLS_A_WORD * n and all(out[f"dup_chars_{k}"] <= share * word_chars for k, share in MAX_NGRAM_SHARE.items())
    return out


def rules(docs: DataFrame) -> DataFrame:
    """The counts and the verdict `kept` for each row of docs.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, each by itself; a null doc_id
    stays null; other columns are ignored; an empty table gives no rows. Whole texts are read, a document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py() or b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in list(_TYPES.items())[1:])], names=list(_TYPES))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, whatever their names, in docs' order.

    Null and empty texts go, as in `rules`. Each row stays or goes by its own text, so ids may repeat, rows without an id are
    judged too, and repeated rows stay or go together. An empty table gives no rows.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([measure((t.as_py() or "").encode())["kept"] for t in b.column(at)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS w FROM texts),
counts AS (SELECT r, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars FROM words),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([3, 5, 7, 10]) AS k))),
twice AS (SELECT r, k, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS c FROM grams) WHERE c > 1),
places AS (SELECT DISTINCT r, k, p FROM (SELECT r, k, unnest(range(i, i + k)) AS p FROM twice)),
covers AS (SELECT p.r, count(*) FILTER (k = 3) AS n_repeat_words, sum(length(w[p])) FILTER (k = 5) AS dup_chars_5, sum(length(w[p])) FILTER (k = 7) AS dup_chars_7, sum(length(w[p])) FILTER (k = 10) AS dup_chars_10
  FROM places p JOIN words ON p.r = words.r GROUP BY p.r),
lines AS (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^ \t\n\x0B\x0C\r]') GROUP BY r, line),
line_counts AS (SELECT r, sum(c - 1) AS n_dup_lines, sum(length(line) * c) FILTER (c > 1) AS dup_line_chars, sum(length(line) * c) AS line_chars FROM lines GROUP BY r),
found AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars,
  CAST(coalesce(dup_chars_5, 0) AS BIGINT) AS dup_chars_5, CAST(coalesce(dup_chars_7, 0) AS BIGINT) AS dup_chars_7, CAST(coalesce(dup_chars_10, 0) AS BIGINT) AS dup_chars_10
  FROM texts LEFT JOIN counts USING (r) LEFT JOIN covers USING (r) LEFT JOIN line_counts USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found)
SELECT *, NOT base_failed AND dup_line_chars <= 0.30::DOUBLE * line_chars AND n_symbols <= 0.25::DOUBLE * n_words AND dup_chars_5 <= 0.30::DOUBLE * word_chars AND dup_chars_7 <= 0.28::DOUBLE * word_chars AND dup_chars_10 <= 0.25::DOUBLE * word_chars AS kept FROM judged
"""

"""Token counts that follow edits.

A document is a row of pre-tokens, the stretches within which a byte-pair tokenizer merges. Their lengths and token counts are
the leaves of a segment tree, in blocks, with sums of both at every node. An edit cuts again only from the last pre-token that
could see the edited place to the first place behind it where the old cuts hold again, counts the tokens of the new pre-tokens,
puts them into the blocks that they touch, and updates the sums from there to the root. The leaves can be stored beside the text
(`counted`), so that later edits start from them and never count the whole text again (`edited`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.bpe import _ODD_SPACE, CACHE_ENTRIES, Encoder, encoder
from tempora.llm.common import map_arrow, own_cache

#: How many characters behind its own end a pre-token's cut may depend on.
CONTEXT = 2
LEAVES_A_BLOCK = 64
#: A block that has grown so many times its size makes the tree be built anew.
GROWTH = 8


class _Counts(dict):
    """Token counts of pre-tokens, asked of the tokenizer once each."""

    def __init__(self, enc: Encoder) -> None:
        super().__init__()
        self.enc = enc

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES // 4:
            self.clear()
        # a leading space makes the rest of the piece the word that the encoder's cache has
        ids = self.enc.rest[piece[1:]] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else self.enc.of_text(piece)
        self[piece] = found = len(ids) // self.enc.dtype.itemsize
        return found


class Leaves:
    """Leaves of whole texts: (length, tokens) of each pre-token. A space before another character starts a pre-token, so what
    lies between such spaces is looked up in a cache, and only new stretches are cut by the rule."""

    def __init__(self, enc: Encoder, pattern: regex.Pattern) -> None:
        self.counts, self.pattern = _Counts(enc), pattern
        self.first, self.rest = _Stretches(self, ""), _Stretches(self, " ")
        for cache in (self.counts, self.first, self.rest):
            own_cache("bpe", cache)

    def cut(self, text: str) -> np.ndarray:
        return np.array([(len(p), self.counts[p]) for p in self.pattern.findall(text)], "<i4").reshape(-1, 2)

    def of(self, text: str) -> np.ndarray:
        if not text or _ODD_SPACE.search(text):
            return self.cut(text).astype(np.int64)
        pieces = text.split(" ")
        found = (self.first[pieces[0]] if pieces[0] else b"") + b"".join(map(self.rest.__getitem__, pieces[1:]))
        return np.frombuffer(found, "<i4").reshape(-1, 2).astype(np.int64)


class _Stretches(dict):
    def __init__(self, leaves: Leaves, space: str) -> None:
        super().__init__()
        self.leaves, self.space = leaves, space

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES // 2:
            self.clear()
        self[piece] = found = self.leaves.cut(self.space + piece).tobytes()
        return found


class SegmentTree:
    """Sums of two numbers over blocks, by position: node i has the sums of nodes 2 i and 2 i + 1."""

    def __init__(self, sums: np.ndarray) -> None:
        self.n = 1 << max(0, len(sums) - 1).bit_length()
        self.node = np.zeros((2 * self.n, 2), np.int64)
        self.node[self.n : self.n + len(sums)] = sums
        width = self.n
        while width > 1:
            width //= 2
            self.node[width : 2 * width] = self.node[2 * width : 4 * width].reshape(width, 2, 2).sum(1)

    def set(self, i: int, sums: tuple[int, int]) -> None:
        i += self.n
        change = np.array(sums) - self.node[i]
        while i:
            self.node[i] += change
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at`, or the last one with any, and where it starts."""
        i, before = 1, 0
        while i < self.n:
            i *= 2
            left = int(self.node[i, 0])
            if at >= before + left and self.node[i + 1, 0]:
                before, i = before + left, i + 1
        return i - self.n, before


class Document:
    """A text with its pre-tokens and their token counts."""

    def __init__(self, text: str, leaves: Leaves, stored: bytes | None = None) -> None:
        """`stored` has the leaves that `leaf_bytes` gave for this text; if they don't add up to it, it is counted anew."""
        self.text, self.leaves = text, leaves
        self.recounted = 0
        both = None if stored is None or len(stored) % 8 else np.frombuffer(stored, "<i4").reshape(-1, 2).astype(np.int64)
        self._build(leaves.of(text) if both is None or both[:, 0].sum() != len(text) else both)

    def leaf_bytes(self) -> bytes:
        return np.concatenate(self.blocks).astype("<i4").tobytes()

    def _build(self, both: np.ndarray) -> None:
        cuts = np.arange(0, len(both), LEAVES_A_BLOCK)
        self.blocks = [both[c : c + LEAVES_A_BLOCK] for c in cuts] or [both]
        self.tree = SegmentTree(np.add.reduceat(both, cuts, axis=0) if len(cuts) else np.zeros((1, 2), np.int64))

    @property
    def n_tokens(self) -> int:
        return int(self.tree.node[1, 1])

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.blocks))

    def _leaves(self, block: int, leaf: int) -> Iterator[tuple[int, int, int]]:
        """(block, leaf, length) from a leaf on."""
        while block < len(self.blocks):
            sizes = self.blocks[block][:, 0].tolist()
            for j in range(leaf, len(sizes)):
                yield block, j, sizes[j]
            block, leaf = block + 1, 0

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts `new` in the place of the code points from start to stop; places beyond the text mean its end."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        shift = len(new) - (stop - start)
        block, at = self.tree.find(max(0, start - CONTEXT))
        ends = at + np.cumsum(self.blocks[block][:, 0])
        leaf = int(np.searchsorted(ends, start - CONTEXT, "right")) if len(ends) else 0
        leaf = min(leaf, max(0, len(ends) - 1))
        at += int(self.blocks[block][:leaf, 0].sum())
        self.text = self.text[:start] + new + self.text[stop:]
        # the old leaves from there on, with where they end in the new text
        old, added, old_end = self._leaves(block, leaf), [], at
        last_block, last_leaf, end = block, leaf, at  # the first old leaf that stays
        for m in self.leaves.pattern.finditer(self.text, at):
            if end >= start + len(new) and old_end >= stop and old_end + shift == end:
                break
            end = m.end()
            added.append((end - m.start(), self.leaves.counts[m[0]]))
            while old_end < stop or old_end + shift < end:
                nxt = next(old, None)
                if nxt is None:
                    break
                last_block, last_leaf, old_end = nxt[0], nxt[1] + 1, old_end + nxt[2]
        else:
            last_block, last_leaf = len(self.blocks) - 1, len(self.blocks[-1])
        self.recounted += len(added)
        fresh = np.array(added, np.int64).reshape(-1, 2)
        kept = self.blocks[last_block][last_leaf:]
        self.blocks[block] = np.concatenate([self.blocks[block][:leaf], fresh, *([kept] if last_block == block else [])])
        for b in range(block + 1, last_block):
            self.blocks[b] = fresh[:0]
        if last_block != block:
            self.blocks[last_block] = kept
        if len(self.blocks[block]) > GROWTH * LEAVES_A_BLOCK:
            self._build(np.concatenate(self.blocks))
            return
        for b in range(block, last_block + 1):
            self.tree.set(b, tuple(self.blocks[b].sum(0)))


_EDITS = "array<struct<start:long,stop:long,new:string>>"


def edit_counts(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_pretokens (before the edits), n_recounted (pre-tokens counted for them).

    docs has doc_id, text and edits, an array of structs (start, stop, new) that apply in order, each to the text as the ones
    before it have left it. Null and empty texts have no tokens until an edit adds some; null edits are none, and a null part of
    an edit is 0 or empty; repeated rows are counted each by itself; other columns are ignored; an empty table gives no rows.
    `pattern` is the tokenizer's rule for pre-tokens.
    """
    names = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = _leaves(tokenizer, pattern)
        for b in batches:
            rows = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                doc = Document(text or "", leaves)
                before = doc.n_tokens, doc.n_pretokens
                for e in edits or []:
                    if e is not None:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                rows.append((before[0], doc.n_tokens, len(doc.text), before[1], doc.recounted))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(_EDITS)), run, ", ".join(f"{n} long" for n in names), "bpe")


_STORED = "doc_id long, text string, leaves binary, n_tokens long, n_recounted long"


def _stored(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = _leaves(tokenizer, pattern)
        for b in batches:
            rows = []
            for text, own, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                doc = Document(text or "", leaves, own)
                for e in edits or []:
                    if e is not None:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                rows.append((text if text is None and not doc.text else doc.text, doc.leaf_bytes(), doc.n_tokens, doc.recounted))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "text", "leaves", "n_tokens", "n_recounted"])

    return map_arrow(docs, run, _STORED, "bpe")


def counted(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, text, leaves (what later edits start from), n_tokens and n_recounted (0) of each row of docs.

    A null text stays null and has no tokens; empty texts have none; repeated rows are counted each by itself; other columns are
    ignored; an empty table gives no rows.
    """
    none = F.lit(None)
    return _stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), none.cast("binary").alias("leaves"), none.cast(_EDITS).alias("edits")), tokenizer, pattern)


def edited(stored: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """The same columns after the edits of `edits` (as in `edit_counts`), from the text and leaves that `counted` or `edited` gave.

    Only what the edits touch is counted: n_recounted pre-tokens. Null leaves, and leaves of another text, mean that the whole
    text is counted; nulls, repeated rows, other columns and empty tables as in `edit_counts`.
    """
    return _stored(stored.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("leaves").cast("binary"), F.col("edits").cast(_EDITS)), tokenizer, pattern)


_LEAVES: dict[tuple[str, str], Leaves] = {}


def _leaves(tokenizer: str, pattern: str) -> Leaves:
    """One cache for each worker process."""
    key = tokenizer, pattern
    if key not in _LEAVES:
        _LEAVES[key] = Leaves(encoder(tokenizer), regex.compile(pattern))
    return _LEAVES[key]


def with_query_edits(docs: DataFrame) -> DataFrame:
    """docs with the edits that the query applies: a tenth is cut from a third on, the text's first 40 characters go into the middle, and the last 20 are replaced."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    third, tenth = F.floor(n / 3), F.floor(n / 10)
    left = n - tenth
    after = left + F.least(n, F.lit(40))
    edit = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), new.alias("new"))
    edits = F.array(edit(third, third + tenth, F.lit("")), edit(F.floor(left / 2), F.floor(left / 2), F.coalesce(F.substring("text", 1, 40), F.lit(""))), edit(F.greatest(after - 20, F.lit(0)), after, F.lit(" edited  text.\n")))
    return docs.select("doc_id", "text", edits.alias("edits"))

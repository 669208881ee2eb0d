"""Packing documents into fixed-length sequences by harmonic classes.

Every piece length falls into a reciprocal-capacity class k, whose slots hold floor(capacity / k) tokens; a sequence of class k
takes k pieces. Documents may be cut, so a piece that would leave too much of its slot empty is cut to fill a slot of the next
class exactly, and the rest is classed again. Each worker fills its own sequences; classes never need to meet across workers.
What is left in unfilled sequences at the end of a partition (fewer than k pieces a class, a constant amount) is laid end to end
and cut into full sequences and, last, sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.bpe import encoder
from tempora.llm.common import map_arrow

CAPACITY = 2048
END_ID = 1
#: A piece stays whole if at most one part in so many of its slot remains empty.
SLOT_PARTS = 256

_TYPES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "sequence_tokens": pa.int64()}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def cut(n: int, capacity: int = CAPACITY, parts: int = SLOT_PARTS) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n tokens."""
    found = [(s, capacity, 1) for s in range(0, n - capacity + 1, capacity)]
    start = len(found) * capacity
    while start < n:
        rest = n - start
        k = capacity // rest
        slot = capacity // k
        if (slot - rest) * parts > slot:
            k, rest = k + 1, capacity // (k + 1)
        found.append((start, rest, k))
        start += rest
    return found


class Bins:
    """The open sequences of one worker: a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def _close(self, pieces: list) -> list[tuple]:
        used, at, out = sum(len(p[2]) for p in pieces), 0, []
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at, used))
            at += len(ids)
        self.next_id += 1
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        """Rows of the sequences that this document fills."""
        out: list[tuple] = []
        for start, length, k in cut(len(ids), self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, start, ids[start : start + length].copy(), len(ids)))
            if len(bin_) == k:
                out += self._close(self.open.pop(k))
        return out

    def finish(self) -> list[tuple]:
        """Rows of what is left, cut into full sequences and powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total, out, room, taken = sum(len(p[2]) for p in left), [], 0, []
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        sizes.reverse()
        for doc, start, ids, n in left:
            while len(ids):
                room = room or sizes.pop()
                taken.append((doc, start, ids[:room], n))
                used = len(taken[-1][2])
                start, ids, room = start + used, ids[used:], room - used
                if not room:
                    out += self._close(taken)
                    taken = []
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, a row each: doc_id, start (tokens of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset in the sequence, sequence_tokens (those in use).

    A sequence whose tokens in use are not a power of two is padded to `capacity`. Null and empty texts are the end id alone;
    rows with a null doc_id and repeated rows are documents like any other; other columns are ignored; an empty table gives no
    rows. A document of any length is one list of ids in memory, and a worker holds at most the open sequences besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bins = Bins(TaskContext.get().partitionId() << 36, capacity)
        end = np.array([end_id], "<u4")

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in _TYPES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES.values(), strict=True)], names=list(_TYPES))

        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py() or ""), enc.dtype).astype("<u4")
                rows += bins.add(doc, np.concatenate([ids, end]))
                if len(rows) >= 2000:
                    yield batch(rows)
                    rows = []
        yield batch(rows + bins.finish())

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA, "bpe")


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of the query: the ids by their checksum."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in ascending doc_id order. Its ids are cut into blocks; a block stores its minimum, and the
differences to it at the bit width that a percentile of them needs. Differences that need more bits keep their low bits in place
and their high bits in an exception list. An index has the first word of each block, so any document's ids are read from the
blocks they lie in alone.

Layout, little-endian, sections padded to 8 bytes:
  header   magic, then unsigned 64-bit: partition, sequence, block length, documents, ids, words, exceptions
  docs     doc_id (64-bit), doc_id given or null (8-bit), ids of the document (64-bit)
  blocks   first word (64-bit), minimum (32-bit), width (8-bit), exceptions (32-bit), one for each block
  words    the packed differences (64-bit), 64 values in `width` words
  patches  place in the block (32-bit), then high bits (32-bit), one for each exception

Files are written through Spark's own text sink, one record a file, and read through its binaryFile source, so they can lie in
any store that Spark reaches, and a task that is run again replaces what it had written. The sink ends a record with a byte
that the format ignores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.bpe import encoder
from tempora.llm.common import map_arrow, shared_path, written
from tempora.sources.files import Files

MAGIC = b"TPFORv01"
BLOCK = 1024
PERCENTILE = 90
END_ID = 2
#: A file ends with the document that takes it to so many ids.
FILE_IDS = 4_000_000
#: Ids that are packed at a time.
_AT_ONCE = 1 << 19


def _widths(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _lanes(width: int) -> list[tuple[int, int, int]]:
    return [(i, i * width >> 6, i * width & 63) for i in range(64)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 64) values below 2 ** width as (n, width) words."""
    out = np.zeros((width, len(values)), np.uint64)
    for i, word, shift in _lanes(width):
        v = values[:, i]
        out[word] |= v << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(words.T)
    out, mask = np.empty((64, words.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i, word, shift in _lanes(width):
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[word + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.T


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> dict[str, np.ndarray]:
    """Sections of the blocks of some ids (unsigned 32-bit); the last block is filled up with its own last id."""
    n = -(-len(ids) // block)
    padded = np.concatenate([ids, np.full(n * block - len(ids), ids[-1] if len(ids) else 0, ids.dtype)]).reshape(n, block).astype(np.uint64)
    low = padded.min(axis=1) if n else np.zeros(0, np.uint64)
    diff = padded - low[:, None]
    width = _widths(np.percentile(diff, percentile, axis=1, method="higher")) if n else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(width * (block // 64))])[:-1] if n else np.zeros(0, np.int64)
    words = np.zeros(int((width * (block // 64)).sum()), np.uint64)
    patched = (diff >> width[:, None].astype(np.uint64)) > 0
    for w in np.unique(width[width > 0]):
        own = np.nonzero(width == w)[0]
        packed = _pack((diff[own] & np.uint64((1 << int(w)) - 1)).reshape(-1, 64), int(w))
        words[(first[own][:, None] + np.arange(int(w) * (block // 64))).ravel()] = packed.ravel()
    at, place = np.nonzero(patched)
    return {"first": first.astype("<u8"), "low": low.astype("<u4"), "width": width.astype("u1"), "patches": patched.sum(axis=1).astype("<u4"), "words": words.astype("<u8"), "place": place.astype("<u4"), "high": (diff[at, place] >> width[at].astype(np.uint64)).astype("<u4")}


def unpack_blocks(s: dict[str, np.ndarray], block: int = BLOCK) -> np.ndarray:
    """All ids of some blocks, with those that fill the last one up."""
    n, width = len(s["low"]), s["width"].astype(np.int64)
    diff = np.zeros((n, block), np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.nonzero(width == w)[0]
        words = s["words"][(s["first"][own].astype(np.int64)[:, None] + np.arange(int(w) * (block // 64))).ravel()]
        diff[own] = _unpack(words.reshape(-1, int(w)), int(w)).reshape(len(own), block)
    at = np.repeat(np.arange(n), s["patches"].astype(np.int64))
    diff[at, s["place"].astype(np.int64)] |= s["high"].astype(np.uint64) << width[at].astype(np.uint64)
    return (diff + s["low"].astype(np.uint64)[:, None]).astype("<u4").ravel()


class FileWriter:
    """Gathers documents and gives the bytes of a file."""

    def __init__(self, partition: int, sequence: int, block: int = BLOCK, percentile: int = PERCENTILE) -> None:
        self.partition, self.sequence, self.block, self.percentile = partition, sequence, block, percentile
        self.docs: list = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.sections: list[dict] = []
        self.n = self.n_waiting = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n += len(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= _AT_ONCE:
            self._pack(last=False)

    def _pack(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        if end:
            self.sections.append(pack_blocks(ids[:end], self.block, self.percentile))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def finish(self) -> bytes:
        self._pack(last=True)
        base = 0
        for s in self.sections:
            s["first"] = s["first"] + np.uint64(base)
            base += len(s["words"])
        all_ = {k: np.concatenate([s[k] for s in self.sections]) if self.sections else np.zeros(0, t) for k, t in (("first", "<u8"), ("low", "<u4"), ("width", "u1"), ("patches", "<u4"), ("words", "<u8"), ("place", "<u4"), ("high", "<u4"))}
        head = np.array([self.partition, self.sequence, self.block, len(self.docs), self.n, len(all_["words"]), len(all_["place"])], "<u8")
        parts = [np.array([d or 0 for d in self.docs], "<i8"), np.array([d is not None for d in self.docs], "u1"), np.array(self.lengths, "<u8"), *all_.values()]
        return MAGIC + head.tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)


class FileReader:
    """documents() gives (doc_id, ids) in file order; ids(i) those of one document from its own blocks."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a file of token-id blocks")
        head = np.frombuffer(data, "<u8", 7, 8).astype(np.int64)
        self.partition, self.sequence, self.block, n_docs, self.n, n_words, n_patches = map(int, head)
        n_blocks, at = -(-self.n // self.block), 64
        self.s: dict[str, np.ndarray] = {}
        for name, kind, n in (("doc", "<i8", n_docs), ("given", "u1", n_docs), ("length", "<u8", n_docs), ("first", "<u8", n_blocks), ("low", "<u4", n_blocks), ("width", "u1", n_blocks), ("patches", "<u4", n_blocks), ("words", "<u8", n_words), ("place", "<u4", n_patches), ("high", "<u4", n_patches)):
            self.s[name] = np.frombuffer(data, kind, n, at)
            at += self.s[name].nbytes + -self.s[name].nbytes % 8
        self.starts = np.concatenate([[0], np.cumsum(self.s["length"].astype(np.int64))])
        self.patch_starts = np.concatenate([[0], np.cumsum(self.s["patches"].astype(np.int64))])

    def __len__(self) -> int:
        return len(self.s["doc"])

    def doc_id(self, i: int) -> int | None:
        return int(self.s["doc"][i]) if self.s["given"][i] else None

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Ids of blocks a to b, b exclusive."""
        p, q = self.patch_starts[a], self.patch_starts[b]
        return unpack_blocks({"words": self.s["words"], **{k: self.s[k][a:b] for k in ("first", "low", "width", "patches")}, "place": self.s["place"][p:q], "high": self.s["high"][p:q]}, self.block)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.starts[i], self.starts[i + 1]
        first = a // self.block
        return self.blocks(first, -(-b // self.block))[a - first * self.block : b - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, some blocks at a time."""
        i, step = 0, max(1, _AT_ONCE // self.block)
        while i < len(self):
            first = self.starts[i] // self.block
            j = max(i + 1, int(np.searchsorted(self.starts, (first + step) * self.block, "right")) - 1)
            ids = self.blocks(first, -(-self.starts[j] // self.block))
            for k in range(i, j):
                yield self.doc_id(k), ids[self.starts[k] - first * self.block : self.starts[k + 1] - first * self.block]
            i = j


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encodes all texts and writes their ids to files below path in ascending doc_id order.

    Null and empty texts are the end id alone; a null doc_id comes first; rows that share an id follow each other, equal ones
    side by side; other columns are ignored; an empty table gives no documents. Rows are dealt by ranges of doc_id and a hash of
    the text, so each worker writes one stretch of the order, and rows that share an id needn't meet; a worker holds one file's
    packed ids and, besides, one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        file = FileWriter(part, 0)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file.add(doc, np.concatenate([np.frombuffer(enc.encode(text.as_py() or ""), enc.dtype).astype("<u4"), end]))
                if file.n >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([file.finish()], pa.binary())], names=["file"])
                    file = FileWriter(part, file.sequence + 1)
        if len(file.docs):
            yield pa.RecordBatch.from_arrays([pa.array([file.finish()], pa.binary())], names=["file"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    map_arrow(dealt, run, "file binary", "bpe").select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files below path: partition, sequence, place (in the file), doc_id, ids (little-endian unsigned 32-bit), file_start (ids before it in its file), file_ids (all of the file).

    A document of null or empty text has the end id alone; a null doc_id comes back null; rows that were equal come back one by
    one; a folder without files gives no rows; a file of another kind is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["partition", "sequence", "place", "doc_id", "ids", "file_start", "file_ids"]
        types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
        for b in batches:
            for data in b.column(0):
                file, rows = FileReader(data.as_py()), []
                for i, (doc, ids) in enumerate(file.documents()):
                    rows.append((file.partition, file.sequence, i, doc, ids.tobytes(), int(file.starts[i]), file.n))
                    if len(rows) == 1000 or i == len(file) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []

    # what the tokenizer has looked up while files were written isn't wanted any more
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, run, "partition long, sequence long, place long, doc_id long, ids binary, file_start long, file_ids long", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, as read back from the files.

    start adds the ids of earlier partitions, of earlier files of the partition and of earlier documents of the file; the sums
    run over one row a file, then over one row a partition.
    """
    rows = written(read_ids(spark, path).select("partition", "sequence", "doc_id", "file_start", "file_ids", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "ids-digest")
    files = rows.groupBy("partition", "sequence").agg(F.max("file_ids").alias("file_ids"))
    parts = files.groupBy("partition").agg(F.sum("file_ids").alias("part_ids"))
    parts = parts.select("partition", F.coalesce(F.sum("part_ids").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = F.coalesce(F.sum("file_ids").over(Window.partitionBy("partition").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.select("partition", "sequence", in_part.alias("in_part")).join(parts, "partition").select("partition", "sequence", (F.col("in_part") + F.col("part_start")).alias("base"))
    return rows.join(bases, ["partition", "sequence"]).select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **options: int) -> DataFrame:
    """Writes the files and gives digest() of them; null, empty, equal and no rows as in write_ids."""
    own, path = not path, path or shared_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, **options)
    if own:
        Files(docs.sparkSession, path).delete_at_end()
    return digest(docs.sparkSession, path)


__all__ = ["FileReader", "FileWriter", "digest", "pack_blocks", "read_ids", "round_trip", "unpack_blocks", "write_ids"]

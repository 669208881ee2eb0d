"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.sources.files import Files, shared_root

#: A word is a run of code points other than the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one Arrow batch may hold: documents can be long, so batches stay short.
BATCH_ROWS = 500


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tempora/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what follows neither repeats the work before it nor depends on the executors that did it. The files go when the application ends, or with `forget`."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    Files(df.sparkSession, path).delete_at_end()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tempora_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of what `written` gave, once nothing reads them any more."""
    Files(df.sparkSession, df.tempora_path).delete()


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches short, and sees to it that workers have this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "") -> DataFrame:
    """mapInArrow in short batches; a worker that starts on it keeps the caches of `owner` only."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches(owner)
        yield from f(batches)

    return df.mapInArrow(run, schema)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application, where they would not find it: the driver has it neither in its folder nor in PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not root.is_dir() or root in {Path.cwd(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)}:
        return
    _SHIPPED.add(app)
    to = Path(tempfile.mkdtemp()).resolve() / "tempora.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted((root / "tempora").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(to))


_CACHES: dict[str, list] = {}


def own_cache(owner: str, cache: dict) -> None:
    """Counts a cache of a worker process to an operator family."""
    _CACHES.setdefault(owner, []).append(cache)


def only_caches(owner: str) -> None:
    """Empties the caches of other families: a worker serves one stage after the other and needn't hold what an earlier one has looked up."""
    held = [c for name, caches in _CACHES.items() if name != owner for c in caches if c]
    for c in held:
        c.clear()
    if held:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()


def _trim() -> None:
    """Gives freed memory back to the system where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

"""Folders of a dataset in any store that Spark reaches."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder if there is one machine, as in tests, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "tempora-shared")
    return at.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.spark = spark.sparkContext._jvm, spark
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self._path(name)))

    def folders(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)) if s.isDirectory())

    def names(self, name: str) -> list[str]:
        """The files of a folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)) if not s.isDirectory())

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_new(self, name: str, text: str) -> bool:
        """Writes a file unless it is there."""
        try:
            self.write(name, text, overwrite=False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def delete_at_end(self, name: str = "") -> None:
        """Has a folder removed when the application ends."""
        self.fs.deleteOnExit(self._path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"can't rename {self.at(old)} to {self.at(new)}")

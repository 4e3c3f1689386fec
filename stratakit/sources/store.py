"""Stored tables whose versions are published atomically.

A version is written to a folder of its own; a pointer file with the next number is then
renamed into place, which fails if another writer has published that number first.  Readers
follow the largest pointer, so they see the old version or the new one, never a part, and a
writer that dies leaves the old one in force.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluate import upsert_by_key


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._jvm, self._Path = jvm, jvm.org.apache.hadoop.fs.Path
        root = self._Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        # Unlike a file system's rename, a context's never replaces the target.
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _pointer(self, number: int):
        return self._Path(f"{self.path}/pointers/{number:012d}")

    def version(self) -> int:
        """Number of the version in force, 0 if there is none."""
        folder = self._Path(f"{self.path}/pointers")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._pointer(number))
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The version in force, None if there is none."""
        number = self.version()
        return self.spark.read.parquet(self._folder(number)) if number else None

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Writes ``df`` as the version after ``after`` (by default the one in force now)."""
        number = (self.version() if after is None else after) + 1
        name = f"version-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        draft = self._Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.writeUTF(name)
        stream.close()
        self._fs.mkdirs(self._Path(f"{self.path}/pointers"))
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._pointer(number), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {number} of {self.path} is already published") from e
        return number

    def upsert(self, new: DataFrame, key: str | list[str]) -> int:
        """Publishes the table with the rows of every ``key`` in ``new`` replaced."""
        before = self.version()
        merged = new if not before else upsert_by_key(self.spark.read.parquet(self._folder(before)), new, key)
        return self.publish(merged, before)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the latest ``keep`` versions; how many went."""
        latest, gone = self.version(), 0
        for number in range(latest - max(1, keep), 0, -1):
            if not self._fs.exists(self._pointer(number)):
                break
            self._fs.delete(self._Path(self._folder(number)), True)
            self._fs.delete(self._pointer(number), False)
            gone += 1
        return gone

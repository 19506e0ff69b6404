"""A folder of a keyspace through Spark's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import file_kind


class FileExists(OSError):
    pass


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def full(self, name: str) -> str:
        return f"{self.path}/{name}"

    def names(self) -> DataFrame:
        """name, kind and number of what lies in the folder; kind is null for what is no file of a store."""
        name = F.col("name")
        found = self.spark.createDataFrame([(x,) for x in self.list()], "name string")
        return found.select("name", file_kind(name).alias("kind"), F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("number"))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def changed(self, name: str) -> float:
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def touch(self, name: str) -> None:
        """Set the time of change to now, where the file system lets that be set."""
        self._fs.setTimes(self._path(name), int(time.time() * 1000), -1)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """Writes a file; without overwrite it fails if there is one, which decides between writers."""
        try:
            stream = self._fs.create(self._path(name), overwrite)
        except Exception as e:
            if self.exists(name):
                raise FileExists(name) from e
            raise
        stream.write(data)
        stream.close()

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't move {name} to {to}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

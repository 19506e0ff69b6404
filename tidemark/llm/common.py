"""What several operators need: the shared folder, written tables, words of a text."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one on a single machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(spark, "_tidemark_folder", None):
        spark._tidemark_folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return spark._tidemark_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when this process ends."""
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path that new_folder gave, once nothing reads it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written[:] = [x for x in _written if x[1] != path]


class Written:
    """A table written to the shared folder, in folders by the columns parted: its lineage is cut and lost executors cost
    nothing."""

    def __init__(self, df: DataFrame, name: str, *parted: str):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, name)
        df.write.option("compression", "zstd").partitionBy(*parted).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's objects for them are gone."""
    gc.collect()
    spark._jvm.System.gc()


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}") in taken:
        pass
    return name

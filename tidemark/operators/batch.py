"""Batches of operations that take effect together, and the versions they get."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import as_key
from ..model import DELETE, PUT


class WriteBatch:
    """Puts and deletes in order; a later one on the same key wins."""

    def __init__(self) -> None:
        self._ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, k: bytes | str, v: bytes | str) -> WriteBatch:
        self._ops.append((PUT, as_key(k), as_key(v)))
        return self

    def delete(self, k: bytes | str) -> WriteBatch:
        self._ops.append((DELETE, as_key(k), None))
        return self

    def clear(self) -> WriteBatch:
        self._ops.clear()
        return self

    def append(self, other: WriteBatch) -> WriteBatch:
        self._ops += other._ops
        return self

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes | None]]:
        return iter(self._ops)

    def __len__(self) -> int:
        return len(self._ops)

    @property
    def n_bytes(self) -> int:
        return sum(len(k) + len(v or b"") for _, k, v in self._ops)


def dealt(ops: DataFrame, order: list[Column | str]) -> DataFrame:
    """ops by range of a total order, with _part; kept on disk, so that counting and numbering see the same ranges.

    Unpersist it when the result of with_versions is written.
    """
    return ops.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)


def with_versions(parted: DataFrame, base: int, order: list[Column | str]) -> DataFrame:
    """k, seq, op, v of what dealt() gave: seq is base + place, from 1.

    Rows are counted in each range, a number for each comes to the driver, and each range is sorted and numbered where it
    lies, from the sum of the counts before. No task sees all rows, and nothing is shuffled.
    """
    counts = dict(parted.groupBy("_part").count().collect())
    before, at = [], base
    for i in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(i, 0)
    if not before:
        return parted.select("k", F.lit(0).cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), "v")
    # the low bits of these ids are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = parted.sortWithinPartitions(*order).withColumn("_place", place)
    return placed.select("k", (F.get(F.lit(before), F.col("_part")) + F.col("_place") + 1).cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), "v")


def leading_group(waiting: Sequence[tuple[int, bool]], cap: int = 1 << 20, small: int = 128 << 10) -> int:
    """How many of the waiting writers (bytes, sync) commit together, the first of them leading: as many as stay below a
    limit, which is lower where the first is small, and no sync writer behind one that is not. Fixed values: 1 MiB, 128 KiB."""
    n, sync = waiting[0]
    limit = n + small if n <= small else cap
    for i, (size, wants_sync) in enumerate(waiting):
        if i:
            n += size
            if n > limit or (wants_sync and not sync):
                return i
    return len(waiting)


def group_sizes(ops: DataFrame, limit: float, order: str = "seq") -> DataFrame:
    """ops with commit_group: those whose running size falls in the same span of `limit` bytes commit together.

    Sizes are summed by blocks of versions first, so the running sum over all ops is two-level.
    """
    block = F.floor(F.col(order) / 4096.0)
    sized = ops.withColumn("_block", block)
    sums = sized.groupBy("_block").agg(F.sum("n_bytes").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n_bytes").over(Window.partitionBy("_block").orderBy(order))
    placed = sized.join(sums.select("_block", before.alias("_before")), "_block").withColumn("running", F.col("_before") + within)
    return placed.withColumn("commit_group", F.floor(F.col("running") / F.lit(float(limit))).cast("long")).drop("_block", "_before")

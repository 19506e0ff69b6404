"""Schemas and options.

A keyspace is a change log of rows (k, seq, op, v): key, version, 0 for a deletion or 1 for a value, value. Its state at
version S is the newest row of each key with seq <= S, without deletions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 1
LOG = T.StructType(
    [
        T.StructField("k", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("v", T.BinaryType(), True),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_no", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("n_rows", T.LongType(), False),
        T.StructField("smallest_k", T.BinaryType(), False),
        T.StructField("largest_k", T.BinaryType(), False),
        T.StructField("min_seq", T.LongType(), False),
        T.StructField("max_seq", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class Options:
    """Levels 7, level-0 limits 4, 8 and 12, deepest flush level 2, level budget 10 MiB times 10 a level,
    overlap limits 10 and 25 files, a write that waits 1 s, lock stale after 10 s. The sizes of buffer and files suit Parquet on a cluster."""

    levels: int = 7
    l0_trigger: int = 4
    l0_slowdown: int = 8
    l0_stop: int = 12
    slowdown_s: float = 1.0
    max_flush_level: int = 2
    level_bytes: int = 10 << 20
    level_factor: int = 10
    grandparent_factor: int = 10
    expand_factor: int = 25
    write_buffer: int = 4 << 20
    max_file_size: int = 128 << 20
    bloom_on_key: bool = True
    lock_stale_s: float = 10.0
    checkpoint_every: int = 16
    auto_compact: bool = True
    create_if_missing: bool = True
    error_if_exists: bool = False

    def max_bytes(self, level: int) -> float:
        """The budget of a level; levels 0 and 1 have the same."""
        return float(self.level_bytes * self.level_factor ** max(0, level - 1))


@dataclass(frozen=True)
class FileMeta:
    """A sorted Parquet file of a keyspace."""

    level: int
    file_no: int
    path: str
    size: int
    n_rows: int
    smallest_k: bytes
    largest_k: bytes
    min_seq: int
    max_seq: int

    def overlaps(self, lo: bytes | None, hi: bytes | None) -> bool:
        return not ((lo is not None and self.largest_k < lo) or (hi is not None and self.smallest_k > hi))

    def to_json(self) -> dict:
        return self.__dict__ | {"smallest_k": self.smallest_k.hex(), "largest_k": self.largest_k.hex()}

    @staticmethod
    def from_json(x: dict) -> FileMeta:
        return FileMeta(**x | {"smallest_k": bytes.fromhex(x["smallest_k"]), "largest_k": bytes.fromhex(x["largest_k"])})

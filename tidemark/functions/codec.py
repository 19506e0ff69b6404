"""Small encodings: variable-length and fixed numbers, checksums, file names, bloom filters."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = {"MANIFEST": r"MANIFEST-(\d+)", "log": r"(\d+)\.log", "table": r"(\d+)\.ldb", "temp": r"(\d+)\.dbtmp"}
_PLAIN = {"CURRENT": "current", "LOCK": "lock", "LOG": "info", "LOG.old": "info"}


def varint(n: int) -> bytes:
    """Seven bits a byte, low ones first; the top bit says that more follow."""
    if n < 0:
        raise ValueError("a varint is not negative")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the varint ends early")
        n |= (data[at] & 0x7F) << shift
        at += 1
        if not data[at - 1] & 0x80:
            return n, at
        shift += 7


def fixed(n: int, width: int) -> bytes:
    """Little-endian; 8-byte numbers stop at 2^56 - 1, the largest version."""
    return min(n, (1 << 56) - 1 if width == 8 else (1 << 8 * width) - 1).to_bytes(width, "little")


def read_fixed(data: bytes) -> int:
    return int.from_bytes(data, "little")


def internal_key(k: bytes, seq: int, op: int) -> bytes:
    return k + seq.to_bytes(7, "little") + bytes([op])


def parse_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8 or data[-1] > 1:
        raise ValueError("not an internal key")
    return data[:-8], int.from_bytes(data[-8:-1], "little"), data[-1]


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def file_name(kind: str, number: int) -> str:
    return {"log": f"{number:06d}.log", "table": f"{number:06d}.ldb", "temp": f"{number}.dbtmp", "MANIFEST": f"MANIFEST-{number:06d}"}[kind]


def parse_file_name(name: str) -> tuple[str, int] | None:
    if name in _PLAIN:
        return _PLAIN[name], 0
    return next(((kind, int(m[1])) for kind, p in _NAMES.items() if (m := re.fullmatch(p, name))), None)


def file_kind(name: Column) -> Column:
    """The same for a column of names."""
    kind = F.lit(None).cast("string")
    for k, p in _NAMES.items():
        kind = F.when(name.rlike(f"^{p}$"), k).otherwise(kind)
    for n, k in _PLAIN.items():
        kind = F.when(name == n, k).otherwise(kind)
    return kind


def get_bit(c: Column, place: Column) -> Column:
    return F.call_function("bit_get", c, place)


def set_bit(c: Column, place: Column) -> Column:
    return c.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))


def bloom_bits(keys: DataFrame, k: str = "k", bits_per_key: int = 10, expected: int = 1 << 16) -> DataFrame:
    """(word, bits) of a bloom filter over keys: double hashing, as many probes as round(0.69 times bits a key)."""
    return _probes(keys, k, bits_per_key, expected).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bloom_may_have(keys: DataFrame, bloom: DataFrame, k: str = "k", bits_per_key: int = 10, expected: int = 1 << 16) -> DataFrame:
    """keys with may_have; never false for a key that the filter was made from. Equal keys give one row."""
    asked = _probes(keys.distinct(), k, bits_per_key, expected)
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return asked.join(bloom, "word", "left").groupBy(k).agg(F.min(hit).alias("may_have"))


def _probes(keys: DataFrame, k: str, bits_per_key: int, expected: int) -> DataFrame:
    n_bits, n_probes = max(64, expected * bits_per_key), max(1, round(bits_per_key * 0.69))
    step = F.hash(k).cast("long")
    at = [F.pmod(F.xxhash64(k) % (1 << 40) + i * step, F.lit(n_bits)) for i in range(n_probes)]
    probes = keys.select(k, F.explode(F.array(*at)).alias("at"))
    return probes.select(k, F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bit"))

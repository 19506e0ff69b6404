"""Keys as bytes whose unsigned order is the order of the values, as column expressions.

Composite keys: strings and binary values but for the last part must be terminated, as `text_key(..., last=False)` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(c: Column | str, last: bool = True) -> Column:
    """UTF-8 bytes; within a composite a zero byte becomes 00 FF and 00 01 ends the part."""
    raw = F.encode(c, "UTF-8")
    return raw if last else _terminated(raw)


def _terminated(raw: Column) -> Column:
    pairs = F.regexp_replace(F.hex(raw), "([0-9A-F]{2})", "$1,")
    return F.unhex(F.concat(F.replace(F.replace(pairs, F.lit("00,"), F.lit("00FF,")), F.lit(","), F.lit("")), F.lit("0001")))


def long_key(c: Column | str) -> Column:
    """Eight bytes, big-endian, with the sign bit turned."""
    turned = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.lpad(F.hex(turned.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def double_key(c: Column | str) -> Column:
    """Eight bytes in the order of the numbers; NaN comes last and -0.0 counts as 0.0."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    x = F.when(x == 0, F.lit(0.0)).otherwise(x)
    bits = F.conv(F.hex(_double_bits(x)), 16, -10).cast("long")
    sortable = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.lpad(F.hex(sortable), 16, "0"))


def _double_bits(x: Column) -> Column:
    """The IEEE 754 bytes, worked out from sign, exponent and fraction, as SQL has no cast for them."""
    a = F.abs(x)
    exponent = F.when(a < F.lit(2.0**-1022), F.lit(-1023)).otherwise(F.least(F.lit(1023), F.floor(F.log2(a))).cast("int"))
    # log2 can be off by one next to powers of two
    exponent = F.when((exponent > -1023) & (F.pow(F.lit(2.0), exponent) > a), exponent - 1).when((exponent > -1023) & (exponent < 1023) & (F.pow(F.lit(2.0), exponent + 1) <= a), exponent + 1).otherwise(exponent)
    half = F.pow(F.lit(2.0), F.floor(-exponent / 2).cast("int"))
    scaled = a * half * F.pow(F.lit(2.0), -exponent - F.floor(-exponent / 2).cast("int"))
    fraction = F.when(exponent == -1023, a * F.lit(2.0**537) * F.lit(2.0**537)).otherwise((scaled - 1) * F.lit(2.0**52))
    bits = F.when(F.isnan(x), F.lit(0x7FF8 << 48)).when(a == float("inf"), F.lit(0x7FF << 52)).otherwise(((exponent + 1023).cast("long") * F.lit(1 << 52)) + fraction.cast("long"))
    return F.unhex(F.lpad(F.hex(F.when((x < 0) & ~F.isnan(x), bits.bitwiseXOR(F.lit(-(1 << 63)))).otherwise(bits)), 16, "0"))


def composite_key(*parts: Column) -> Column:
    return F.concat(*parts)


# --- on the driver, for bounds of scans


def as_key(x: bytes | str | int) -> bytes:
    if isinstance(x, str):
        return x.encode()
    return (x + (1 << 63)).to_bytes(8, "big") if isinstance(x, int) else bytes(x)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with prefix; None if there is no bound."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def separator(a: bytes, b: bytes) -> bytes:
    """A short key k with a <= k < b."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if n < min(len(a), len(b)) and a[n] < 0xFF and a[n] + 1 < b[n]:
        return a[:n] + bytes([a[n] + 1])
    return a

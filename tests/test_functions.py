import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec, keys
from tidemark.sources.wal import decode, encode


@given(st.integers(0, 1 << 70))
def test_varint(n):
    assert codec.read_varint(codec.varint(n)) == (n, len(codec.varint(n)))
    assert codec.read_varint(b"x" + codec.varint(n), 1)[0] == n


def test_numbers():
    assert codec.varint(300) == b"\xac\x02"
    assert codec.fixed(1 << 60, 8) == codec.fixed((1 << 56) - 1, 8) and codec.read_fixed(codec.fixed(77, 4)) == 77
    with pytest.raises(ValueError):
        codec.read_varint(b"\x80")


@given(st.binary(), st.integers(0, (1 << 56) - 1), st.integers(0, 1))
def test_internal_key(k, seq, op):
    assert codec.parse_internal_key(codec.internal_key(k, seq, op)) == (k, seq, op)


@pytest.mark.parametrize("name, found", [("CURRENT", ("current", 0)), ("LOG.old", ("info", 0)), ("MANIFEST-000007", ("MANIFEST", 7)), ("000012.log", ("log", 12)), ("000012.ldb", ("table", 12)), ("3.dbtmp", ("temp", 3)), ("x.log", None)])
def test_file_names(name, found):
    assert codec.parse_file_name(name) == found
    if found and found[1]:
        assert codec.file_name(*found) == name


@given(st.binary(max_size=4))
def test_successor(p):
    s = keys.successor(p)
    assert s is None and p.strip(b"\xff") == b"" or s > p + b"\xff" * 5 and not s.startswith(p)


@given(st.binary(max_size=4), st.binary(max_size=4))
def test_separator(a, b):
    a, b = sorted((a, b))
    if a < b:
        assert a <= keys.separator(a, b) < b


@given(st.lists(st.tuples(st.integers(0, 1), st.binary(max_size=5), st.binary(max_size=5)), max_size=5), st.integers(1, 1 << 40))
def test_log_records(ops, first):
    ops = [(o, k, v if o else None) for o, k, v in ops]
    data = encode(first, ops) * 2
    assert list(decode(data)) == [(first, ops)] * 2
    assert list(decode(data[:-1])) == [(first, ops)]


def test_key_order(spark):
    longs = [0, 1, -1, 255, 256, (1 << 63) - 1, -(1 << 63), 77, -300]
    doubles = [0.0, 1.0, -1.0, 1.5, -1.5, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 3.141592653589793, 0.1, 0.30000000000000004, 8.0, 7.999999999999999, 2.0**-1030, 1e-300, 1e300]
    rows = spark.createDataFrame([(x,) for x in longs], "x long").select("x", keys.long_key("x").alias("k")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: bytes(r.k))] == sorted(longs) and all(bytes(r.k) == keys.as_key(r.x) for r in rows)
    rows = spark.createDataFrame([(x,) for x in doubles], "x double").select("x", keys.double_key("x").alias("k")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: bytes(r.k))] == sorted(doubles)
    for r in rows:
        n = struct.unpack(">Q", struct.pack(">d", r.x))[0]
        assert int.from_bytes(bytes(r.k), "big") == (n ^ (1 << 63) if not n >> 63 else n ^ ((1 << 64) - 1)), r.x


def test_composite_order(spark):
    rows = [(a, b) for a in ("", "a", "a\0", "ab", "b", "\0", "a\0b") for b in (-5, 0, 7)]
    got = spark.createDataFrame(rows, "a string, b long").select("a", "b", keys.composite_key(keys.text_key("a", last=False), keys.long_key("b")).alias("k")).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: bytes(r.k))] == sorted(rows, key=lambda r: (r[0].encode(), r[1]))


def test_bloom(spark):
    have, other = spark.range(500).select(F.col("id").alias("k")), spark.range(10_000, 12_000).select(F.col("id").alias("k"))
    bloom = codec.bloom_bits(have, expected=500)
    assert codec.bloom_may_have(have, bloom, expected=500).where("NOT may_have").count() == 0
    assert codec.bloom_may_have(other, bloom, expected=500).where("may_have").count() < 2000 * 0.05

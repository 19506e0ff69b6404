"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(found, names):
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, data, duck, name):
    got = catalogue.QUERIES[name](spark, data)
    con = duck.execute(catalogue.ORACLE_SQL[name])
    names, expected = [c[0] for c in con.description], con.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(expected, names)


def test_hashes(spark, data):
    import xxhash

    names = {r.c_custkey: r.c_name for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    got = catalogue.QUERIES["hashes"](spark, data).collect()
    assert len(got) == len(names) and all(r.hash % (1 << 64) == xxhash.xxh64_intdigest(names[r.c_custkey].encode(), 42) for r in got)


def test_ranges_against_brute_force(spark, monkeypatch):
    import random

    from tidemark.operators import ranges

    r = random.Random(2)
    rows = [(i, r.randrange(60) if r.random() > 0.05 else None, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a int, _range string")
    want = {i: 1 + sum((b is None and a is not None) or (b is not None and a is not None and b < a) for _, b, _ in rows) for i, a, _ in rows}
    for n in (1, 7):
        assert {x.id: x.place for x in ranges.ranked(df.drop("_range"), ["a"], "place", n).collect()} == want
    files = [(i, lo, lo + r.randrange(8)) for i in range(60) for lo in [r.randrange(200)]]
    f = spark.createDataFrame(files, "file_no int, lo int, hi int")
    assert sorted(map(tuple, ranges.overlaps(f, 5).collect())) == sorted((a, b) for a, x, y in files for b, z, w in files if a < b and x <= w and z <= y)
    own, held = spark.range(230).selectExpr("int(id) AS k"), f.selectExpr("lo AS smallest_k", "hi AS largest_k")
    inside = sorted(k for k in range(230) if any(lo <= k <= hi for _, lo, hi in files))
    for limit in (10_000, 3):
        monkeypatch.setattr(ranges, "MAX_BROADCAST", limit)
        assert sorted(x.k for x in ranges.inside(own, held, 5).collect()) == inside


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

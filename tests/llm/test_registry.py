import duckdb
import pytest
from tidemark.llm import registry

TABLES = "documents pages conversations labels benchmark embeddings".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = registry.QUERIES[name](spark, data)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in got.collect()), key=repr) == want


def test_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))

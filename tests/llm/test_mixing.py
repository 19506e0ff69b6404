import collections
import re

import cases
import pytest
from tidemark.llm import mixing as M


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        c = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * c > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out | {s: w[s] * c for s in free}


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 150)])
def test_mix(spark, seed, n):
    rows = cases.rows(seed, n)
    got = M.mix(cases.documents(spark, seed, n)).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((r[0], count(r[1])) for r in rows), key=repr)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want = targets(sizes)
    by_id = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in sizes:  # documents are taken whole, so one that makes up most of its source sets the error
        largest = max(count(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= (largest / 2 if largest > 10_000 else 0.01 * want[s])
    again = M.mix(cases.documents(spark, seed, n).repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_rates_solve_the_dual(spark):
    """One source: all sizes together at the least relative entropy, so the log of rates is linear in size below the cap."""
    cells = spark.createDataFrame([("s", s, n) for s, n in ((1, 500), (10, 300), (40, 60), (100, 9))], "_key string, _size long, n long")
    sources = spark.createDataFrame([("s", "x", 6800, 869, 1, 8000.0)], "_key string, source string, source_size long, n_docs long, least long, target double")
    r = M.tilt(cells, sources).first()
    import math

    words = sum(n * s * min(2, math.exp(r.lam * s / r.mean)) for s, n in ((1, 500), (10, 300), (40, 60), (100, 9)))
    assert abs(words - 8000) < 1 and r.lam > 0


def test_repeat(spark):
    docs = cases.documents(spark)
    out = M.repeat_by_copies(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in M.mix(docs).collect() if r.doc_id not in (5, None)}
    n = collections.Counter(r.doc_id for r in out.collect())
    assert all(n[i] == c for i, c in copies.items())


def test_empty_and_native(spark):
    assert M.mix(cases.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in M.mix(nothing).collect()] == [(0, 0, 0.0)] * 2
    assert not re.search("Python|Arrow|Pandas", M.mix(cases.documents(spark))._jdf.queryExecution().toString())

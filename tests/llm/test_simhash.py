import random
import re

import cases
import pytest
import xxhash
from tidemark.llm import simhash as S


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """The least id of each one's component, by all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(fps))]


def test_documents(spark):
    rows = cases.rows()
    got = S.near_duplicates(cases.documents(spark)).collect()
    fps = [brute(r[1]) for r in rows]
    comp = groups(fps)
    ids = [min((rows[j][0] for j in range(len(rows)) if comp[j] == c and rows[j][0] is not None), default=None) for c in comp]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, ids)), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_links_against_all_pairs(spark, seed):
    r = random.Random(seed)
    fps = [r.getrandbits(64) for _ in range(30)]
    for _ in range(170):  # chains and clusters
        x = r.choice(fps)
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [f - (f >> 63 << 64) for f in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {x.fp: x.component_id for x in S.components(frame).collect()}
    assert [got[f] for f in signed] == groups(fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000)], "u long, v long")
    got = {r.node: r.comp for r in S.connected_components(edges).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0] and 5000 not in got


def test_keep_one(spark):
    docs = cases.documents(spark)
    kept = S.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    comp = groups([brute(r[1]) for r in cases.rows()])
    rows = cases.rows()
    want = []
    for c in sorted(set(comp)):
        own = [rows[j] for j in range(len(rows)) if comp[j] == c]
        want.append(min(own, key=lambda r: (r[0] is None, r[0])))
    assert sorted((tuple(r)[0] for r in kept.collect()), key=repr) == sorted((r[0] for r in want), key=repr)


def test_empty(spark):
    assert S.near_duplicates(cases.empty(spark)).count() == 0
    assert S.keep_one_of_each_group(cases.empty(spark)).count() == 0

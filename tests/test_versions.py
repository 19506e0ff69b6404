"""The read side against a dictionary of versions."""

import random

import pytest

from tidemark.model import LOG
from tidemark.operators import compaction as C
from tidemark.operators import read as R
from tidemark.operators import versions as V


def model(rows, s=None):
    state = {}
    for k, seq, op, v in sorted(rows, key=lambda r: r[1]):
        if s is None or seq <= s:
            state[k] = (op, v)
    return {k: v for k, (op, v) in state.items() if op}


def made(seed, n=300):
    r = random.Random(seed)
    return [(bytes([r.choice([0, 1, 2, 97, 255]) for _ in range(r.randint(0, 2))]), i + 1, int(o := r.random() > 0.3), bytes([r.randint(0, 255)] * r.randint(0, 3)) if o else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, o, None if v is None else bytearray(v)) for k, s, o, v in rows], LOG)


def pairs(df):
    return [(bytes(r["k"]), bytes(r["v"])) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_visible(spark, seed):
    rows = made(seed)
    log = frame(spark, rows)
    for s in (None, 1, 77, 150, 300):
        for by_window in (True, False):
            if by_window:
                assert dict(pairs(V.visible(log, s))) == model(rows, s)
        want = sorted(model(rows, s).items())
        assert pairs(R.scan(log, snapshot=s)) == want
        assert pairs(R.reverse_scan(log, snapshot=s)) == want[::-1]
        assert R.count(log, s).first()["n"] == len(want)


def test_bounds(spark):
    rows = made(5)
    log, live = frame(spark, rows), sorted(model(made(5)).items())
    start = live[len(live) // 2][0]
    assert pairs(R.scan(log, start)) == [x for x in live if x[0] > start]
    assert pairs(R.scan(log, start, inclusive=True)) == [x for x in live if x[0] >= start]
    assert pairs(R.reverse_scan(log, start)) == [x for x in live if x[0] < start][::-1]
    assert pairs(R.prefix_scan(log, b"\xff")) == [x for x in live if x[0].startswith(b"\xff")]
    assert pairs(R.prefix_scan(log, b"a")) == [x for x in live if x[0].startswith(b"a")]
    assert pairs(R.scan(log, limit=3)) == live[:3]


def test_multi_get(spark):
    rows = made(6)
    keys = [b"\x00", b"nowhere", b"\xff\xff", b"\x00"]
    got = R.multi_get(frame(spark, rows), spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")).collect()
    assert {bytes(r["k"]): r["v"] and bytes(r["v"]) for r in got} == {k: model(rows).get(k) for k in set(keys)} and len(got) == 3


def test_numeric_payload_null(spark):
    log = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, None), (2, 1, 1, 7), (2, 2, 0, None)], "k long, seq long, op int, v long")
    for by_window in (True, False):
        assert [tuple(r) for r in V.visible(log, by_window=by_window).collect()] == [(1, 2, None)]


def test_diff(spark):
    rows = made(7)
    a, b = model(rows, 100), model(rows, 200)
    got = {bytes(r["k"]): r["change"] for r in V.diff(frame(spark, rows), 100, 200).collect()}
    last = lambda s: {k: max(q for x, q, _, _ in rows if x == k and q <= s) for k in {r[0] for r in rows if r[1] <= s}}
    old, new = last(100), last(200)
    want = {}
    for k in a.keys() | b.keys():
        if k not in a:
            want[k] = "added"
        elif k not in b:
            want[k] = "removed"
        elif old[k] != new[k]:
            want[k] = "changed"
    assert got == want


def test_empty(spark):
    log = spark.createDataFrame([], LOG)
    assert R.scan(log).count() == R.get(log, b"x").count() == C.compacted(log, 5).count() == 0


@pytest.mark.parametrize("smallest", [1, 100, 300])
def test_compaction_keeps_snapshots(spark, smallest):
    rows = made(8)
    kept = [(bytes(r.k), r.seq, r.op, r.v and bytes(r.v)) for r in C.compacted(frame(spark, rows), smallest).collect()]
    assert len(kept) < len(rows) or smallest == 1
    for s in range(smallest, 301, 20):
        assert model(kept, s) == model(rows, s)


def test_deletions_stay_over_deeper_files(spark):
    """A deletion dropped over an older value further down would bring it back."""
    upper = [(b"b", 10, 0, None), (b"x", 11, 0, None), (b"y", 12, 1, b"new"), (b"y", 9, 1, b"old")]
    deeper = spark.createDataFrame([(bytearray(b"a"), bytearray(b"c"))], "smallest_k binary, largest_k binary")
    kept = {(bytes(r.k), r.seq) for r in C.compacted(frame(spark, upper), 20, deeper).collect()}
    assert kept == {(b"b", 10), (b"y", 12)}
    older = [(b"b", 1, 1, b"v")]
    assert model([x for x in upper if (x[0], x[1]) in kept] + older) == model(upper + older)


def test_pushdown(spark, tmp_path):
    frame(spark, made(9)).write.parquet(str(tmp_path / "t"))
    log = spark.read.schema(LOG).parquet(str(tmp_path / "t"))
    plan = R.get(log, bytearray(b"a"), 50)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(k" in plan.replace("IsNotNull(k), ", "") and "LessThanOrEqual(seq,50)" in plan

import collections
import hashlib
import random
import re

import cases
import numpy as np
import pytest
from tidemark.llm import repeats as R
from tidemark.llm import suffixes as S


def brute(rows, span):
    texts = [(d, (t or "").encode()) for d, t in rows]
    n = collections.Counter(b[i : i + span] for _, b in texts for i in range(len(b) - span + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if n[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def longest_shared(rows):
    """For each row the longest string that another row has too."""
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for i, b in enumerate(texts):
        rest, best = b"\0".join(texts[:i] + texts[i + 1 :]), 0
        for at in range(len(b)):
            while at + best < len(b) and b[at : at + best + 1] in rest:
                best += 1
        out.append(best)
    return out


def got(df, *spans):
    return sorted((tuple(r)[:5] for r in R.remove_repeats(df, *spans).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_small_texts(spark, seed, monkeypatch):
    r = random.Random(seed)
    letters = ["ab", "abcdefghij", "a", "éß∂x"][seed]
    pool = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(6)] + ["", "x"]
    rows = [(i if r.random() > 0.1 else None, None if r.random() < 0.1 else "".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(25)]
    rows += rows[:2]
    monkeypatch.setattr(R, "SHARD", [50, 1 << 22][seed % 2])
    monkeypatch.setattr(R, "HOT", [1 << 20, 4, 3, 1 << 20][seed])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, 12, 8, 4, 3) == brute(rows, 12)


def test_hot_passage(spark, monkeypatch):
    """One passage in many contexts: its hashes are parted, down to single windows, and nothing else changes."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, " ".join([word() for _ in range(4)] + ([passage[: r.choice([30, 45, 99])]] if i % 4 else []) + [word() for _ in range(4)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 30)
    assert sum(x[2] > 0 for x in want) > 60
    long = dict(zip((i for i, _ in rows), longest_shared(rows)))
    for r_ in R.remove_repeats(df, 30, 20, 8, 9).collect():
        # a shared window gives a passage; without a shared anchor there is none
        assert r_.n_passages > 0 if long[r_.doc_id] >= 20 else long[r_.doc_id] >= 8 or r_.n_passages == 0
    for hot in (1, 1 << 20):
        monkeypatch.setattr(R, "HOT", hot)
        assert got(df, 30, 20, 8, 9) == want


def test_cases(spark):
    rows = [(r[0], r[1]) for r in cases.rows(n=12) if r[1] is None or len(r[1]) < 60_000]
    df = cases.documents(spark, n=12).where("text IS NULL OR length(text) < 60000")
    assert got(df) == brute(rows, R.SPAN)
    assert R.remove_repeats(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("memory, block, bins", [(1 << 19, 1 << 16, 256), (7, 5, 3), (20, 64, 2)])
def test_suffixes_and_common_prefixes(memory, block, bins, monkeypatch):
    """Against sorting; small bounds send queues to disk."""
    for name, value in (("MEMORY", memory), ("BLOCK", block), ("BINS", bins)):
        monkeypatch.setattr(S, name, value)
    for seed in range(60):
        r = random.Random(seed)
        a = r.choice([2, 3, 5, 200])
        t = [r.randint(1, a) for _ in range(r.randint(1, 80))]
        t = [t, t[: len(t) // 3] * 3 + t[:9], t[:20] + [1] * r.randint(0, 30) + t[:20]][seed % 3] + [0]
        cap = r.choice([3, 10, 1000])
        weight = np.array([1] + [r.choice([1, 1, 4]) for _ in range(a)], np.int32)
        rows = np.concatenate(list(S.suffixes(np.array(t, np.int32), a + 1, cap, weight)), axis=1)
        order = sorted(range(len(t)), key=lambda i: t[i:], reverse=True)
        assert rows[S.AT].tolist() == order
        assert rows[S.LCP, 0] == 0
        for i, j, n in zip(order, order[1:], rows[S.LCP, 1:].tolist()):
            k = next(k for k in range(len(t)) if t[i + k] != t[j + k])
            assert n == min(cap, sum(weight[t[i : i + k]]))


def test_queue_in_bounded_memory(monkeypatch):
    for name, value in (("MEMORY", 500), ("BLOCK", 100), ("BINS", 8)):
        monkeypatch.setattr(S, name, value)
    r, q, low, want = np.random.RandomState(1), S.Queue(0, 5000), 0, []
    for step in range(200):
        rows = np.stack((np.sort(r.randint(low, 5000, 97)), np.arange(97) + 97 * step, np.zeros(97, np.int64)))
        q.put(rows)
        want += list(zip(rows[0].tolist(), rows[1].tolist()))
        want.sort()
        got = q.peek(40)
        q.skip(got.shape[1])
        assert list(zip(got[0].tolist(), got[1].tolist())) == want[: got.shape[1]]
        want = want[got.shape[1] :]
        low = int(got[0, -1])
    assert q.spilled > 5000 and q.in_memory <= 600


def test_segments_cover_all_windows(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(R, "BLOCK", 100)
    raw = bytes(r.choice(b"abc") for _ in range(1000))
    n = 0
    for _, start, count, anchor in R.segments(raw, 30, 10):
        for s, k, a in zip(start, count, anchor):
            assert s == n and s + k - 1 <= a <= s + 20
            n += k
    assert n == 971
    # a window's hash and its distance from the anchor depend on its bytes alone
    at = {}
    for value, start, count, anchor in R.segments(raw * 2, 30, 10):
        for v, s, k, a in zip(value, start, count, anchor):
            for i in range(s, s + k):
                assert at.setdefault((raw * 2)[i : i + 30], (v, a - i)) == (v, a - i)

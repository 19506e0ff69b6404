import collections
import re

import cases
import numpy as np
from tidemark.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(WORD, x):
            dup += x in seen
            seen.add(x)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    covered = {j for i, x in enumerate(g) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_rules(spark):
    docs = cases.documents(spark)
    got = Q.judge(docs, np.zeros(Q.BUCKETS)).collect()
    want = sorted(((r[0], *brute(r[1])) for r in cases.rows()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_lines_and_windows():
    t = "a b c\n\n \na b c\nx\nx \na b c\r\nq a b c"
    assert Q.base_counts(t.encode(), t.encode().split()) == brute(t)


def test_ratio_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "FOLD", 1 << 62)
    docs = cases.documents(spark)
    good = {1, 2, 3}
    ratios = Q.fit(docs, labels(spark, [(i, 1, 0) for i in good] + [(4, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, None)]), n_buckets=64, prior=10)
    raw, trusted = np.zeros(64), np.zeros(64)
    for t in {r[1] or "" for r in cases.rows()}:
        for b in Q.buckets_of(t.encode(), 64):
            raw[b] += 1
    for r in cases.rows():
        for b in Q.buckets_of((r[1] or "").encode(), 64):
            trusted[b] += r[0] in good
    p = (raw + 0.5) / (raw.sum() + 32)
    assert np.allclose(ratios, np.log((trusted + 10 * p) / (trusted.sum() + 10) / p))
    for r in Q.judge(docs, ratios, 0.01).collect():
        words = dict((x[0], x[1]) for x in cases.rows())[r.doc_id] if r.doc_id is not None else None
        if words:
            assert abs(r.score - ratios[Q.buckets_of(words.encode(), 64)].mean()) < 1e-6 if words.split() else r.score == 0
        assert r.kept == (not r.base_failed and r.score >= 0.01)


def test_cut():
    assert Q.best_cut([0.1, 0.2], [-1.0, -0.5]) == (0.1 - 0.5) / 2
    assert Q.best_cut([], [-1.0]) == Q.best_cut([0.0], []) == Q.THRESHOLD
    r = np.random.RandomState(3)
    for _ in range(50):
        good, bad = r.randint(-3, 6, 20).tolist(), r.randint(-6, 3, 10).tolist()
        errs = lambda t: np.mean([x < t for x in good]) + np.mean([x >= t for x in bad])
        assert abs(errs(Q.best_cut(good, bad)) - min(errs(t) for t in np.arange(-7, 7, 0.25))) < 1e-9


def test_folds_do_not_meet(spark):
    rows = labels(spark, [(i, i % 2, 0) for i in range(400)])
    for good in (True, False):
        a, b = Q.labelled(rows, good)
        assert not set(a) & set(b) and len(a) > len(b) > 20 and set(a + b) == {i for i in range(400) if i % 2 == good}


def test_a_text_and_a_source_of_many_rows(spark):
    """A clean text that makes up a third of the rows is judged as if it stood once."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one = docs.join(marks.where("quality = 1"), "doc_id", "left_semi").where("n_chars BETWEEN 600 AND 2000").orderBy("doc_id").limit(1)
    copies = spark.range(500).crossJoin(one.drop("doc_id")).select((F.col("id") + 10_000_000).alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])
    plain = Q.fit(docs, marks)
    assert np.allclose(Q.fit(docs.unionByName(copies), marks), plain)
    source = docs.groupBy("source").count().orderBy("count").first().source
    grown = docs.unionByName(docs.where(F.col("source") == source).withColumns({"doc_id": F.col("doc_id") + 20_000_000, "text": F.concat("text", F.lit(" "))}))
    ratios = Q.fit(grown, marks)
    kept = Q.judge(one, ratios, Q.threshold(grown, marks, ratios)).first().kept
    assert kept


def test_keep_good_keeps_columns(spark):
    docs = cases.documents(spark)
    kept = Q.keep_good(docs, np.zeros(Q.BUCKETS))
    assert kept.columns == docs.columns
    want = [r for r in cases.rows() if not (b := brute(r[1]))[0] < 50 and not 100 * b[4] > 50 * b[0]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_without_labels_and_rows(spark):
    assert not Q.fit(cases.documents(spark), labels(spark, [])).any()
    assert not Q.fit(cases.empty(spark), labels(spark, [(1, 1, 0)])).any()
    assert Q.judge(cases.empty(spark), np.zeros(8)).count() == 0


def test_bad_documents_go_and_clean_ones_stay(spark):
    """Held-out labels of the test table."""
    d = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = marks.where("doc_id % 2 = 0")
    ratios = Q.fit(docs, half)
    rows = Q.judge(docs, ratios, Q.threshold(docs, half, ratios)).join(marks.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert all(clean) and not any(bad)

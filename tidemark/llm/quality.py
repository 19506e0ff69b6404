"""Quality rules (operator 1): base rules and a hashed n-gram log-likelihood ratio.

Texts are parted into runs of letters and digits and runs of marks. Every run and every pair of neighbouring runs falls
into one of BUCKETS buckets. Two multinomials are counted over
the buckets: one over the whole raw corpus, in which every text counts once however many copies it has, one over trusted
documents. The trusted one is shrunk towards the raw one
(PRIOR pseudo-counts), so that a bucket the trusted documents say little about speaks neither way. A document's score
is the mean over its n-grams of log(p_trusted / p_raw), and it is kept if that is at least a threshold: each document is
decided on its own, the same way in every run.

Marks are parted from letters because junk shows in them, and a mark's count is as sure as a common word's.

The labelled sample is at most MAX_LABELLED rows of `labels` of each kind, those of least xxhash64(doc_id): trusted ones with
quality 1 and toxic 0, bad ones with quality 0. Every FOLD-th of either by that hash is kept from the counts; on this fold
the threshold is set, in the middle of the scores between which it errs least, bad and trusted documents having equal
weight. Without documents of both kinds in the fold it is THRESHOLD. The raw counts cover every document. Copies of a text
go, within partitions and then over a shuffle by digest; counts are summed inside each partition before the shuffle; the
driver gets BUCKETS rows and the fold's scores, whatever the input's size.

What no trusted document is like scores low: a language that has no labels at all is rejected.

Defined cases: a null text has no words; a text without words scores 0 and fails the base rules. Without any trusted
document all scores are 0. Repeated rows are judged alike, each on its own. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes

BUCKETS = 1 << 14
PRIOR = 20_000.0
MAX_LABELLED, FOLD = 20_000, 4
THRESHOLD = -0.32
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The values of BASE for one text and its words."""
    seen: set[bytes] = set()
    n_dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n_repeat = 0
    if len(found := set(windows)) < len(windows):
        counts = Counter(windows)
        to = 0  # words before it are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                n_repeat += i + 3 - max(to, i)
                to = i + 3
    del found
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(raw) - len(raw.translate(None, SYMBOLS)), n_dup, n_repeat


def buckets_of(raw: bytes, n_buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run, then of each pair of neighbours."""
    runs = _RUN.findall(raw)
    h = np.fromiter(map(crc32, runs, repeat(0)), np.uint64, len(runs))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate((h * np.uint64(0xD6E8FEB86659FD93), pairs))
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n_buckets


def labelled(labels: DataFrame, good: bool, at_most: int = MAX_LABELLED) -> tuple[list[int], list[int]]:
    """doc_id of the labelled sample of a kind: those that are counted, and those of the fold that sets the threshold."""
    kind = "quality = 1 AND coalesce(toxic, 0) = 0" if good else "quality = 0"
    ids = labels.where(f"{kind} AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = ids.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(at_most).collect()
    return [r[0] for r in rows if r[1] % FOLD], [r[0] for r in rows if not r[1] % FOLD]


def by_digest(docs: DataFrame) -> DataFrame:
    """digest and text: equal texts in one partition, once for each task that had some."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new = []
            for d in b.column("digest").to_pylist():
                new.append(d not in seen)
                seen.add(d)
            yield b.filter(pa.array(new, pa.bool_()))

    rows = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    return rows.mapInArrow(once, "digest binary, text string").repartition("digest")


def _counts(texts: DataFrame, n_buckets: int, keys: frozenset | None = None) -> np.ndarray:
    """n-grams of each bucket in the texts (key, text), or in those with one of the keys; each key counts once a partition."""
    asked = texts.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(n_buckets, np.int64), set()
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), as_bytes(b, "text"), strict=True):
                if key not in seen and (asked.value is None or key in asked.value):
                    n += np.bincount(buckets_of(t or b"", n_buckets), minlength=n_buckets)
                    seen.add(key)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_buckets)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, prior: float = PRIOR, at_most: int = MAX_LABELLED) -> np.ndarray:
    """log(p_trusted / p_raw) of each bucket."""
    good = _counts(docs.select("doc_id", "text"), n_buckets, frozenset(labelled(labels, True, at_most)[0]))
    if not good.sum():
        return np.zeros(n_buckets)
    raw = _counts(by_digest(docs), n_buckets)
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * n_buckets)
    return np.log((good + prior * p_raw) / (good.sum() + prior) / p_raw)


def best_cut(good: list[float], bad: list[float], otherwise: float = THRESHOLD) -> float:
    """The score that parts good from bad best, each kind having the same weight; the middle between its neighbours."""
    if not good or not bad:
        return otherwise
    scores = np.unique(np.array(good + bad))
    below = np.searchsorted(np.sort(good), scores) / len(good), np.searchsorted(np.sort(bad), scores) / len(bad)
    gain = below[1] - below[0]  # of keeping from this score on
    at = int(gain.argmax())
    return float(scores[at] if at == 0 else (scores[at] + scores[at - 1]) / 2)


def threshold(docs: DataFrame, labels: DataFrame, ratios: np.ndarray, at_most: int = MAX_LABELLED) -> float:
    """From the scores of the fold's documents that the base rules keep."""
    kinds = {i: good for good in (False, True) for i in labelled(labels, good, at_most)[1]}
    if not kinds:
        return THRESHOLD
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in kinds], "doc_id long")
    rows = judge(docs.join(F.broadcast(ids), "doc_id", "left_semi"), ratios).where("NOT base_failed").groupBy("doc_id").agg(F.min("score").alias("score")).collect()
    return best_cut([r.score for r in rows if kinds[r.doc_id]], [r.score for r in rows if not kinds[r.doc_id]])


def _judge(raw: bytes | None, ratios: np.ndarray, threshold: float) -> tuple:
    words = (raw or b"").split()
    base = base_counts(raw or b"", words)
    failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED_PERCENT * base[0]
    score = round(float(ratios[buckets_of(raw, len(ratios))].mean()), 9) if words else 0.0
    return *base, failed, score, not failed and score >= threshold


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the columns of BASE, base_failed, score and kept of every document."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)
    types = [pa.int64()] * len(BASE) + [pa.bool_(), pa.float64(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *BASE, "base_failed", "score", "kept"]
        for b in batches:
            columns = list(zip(*(_judge(t, model.value, threshold) for t in as_bytes(b, "text")), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_judge(t, model.value, threshold)[-1] for t in as_bytes(b, "text")], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over all documents, with counts and threshold from all of them and their labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratios = fit(docs, labels)
    return judge(docs, ratios, threshold(docs, labels, ratios))

"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10).

Two fingerprints within RADIUS = 3 bits always meet at some 64-bit value m that lies within one bit of the one and
within two bits of the other. So every fingerprint emits the ball around itself: all values at distance 0 or 1
("near") and, if it has an odd number of set bits, the values at distance 2 ("far"). Odd ones suffice, as fingerprints
at distance 3 differ in parity; and of three differing bits two lie in the same half of the word, so only the 992
pairs of bits within a half are flipped. Rows are shuffled on m.

At one m, two near members differ in at most 2 bits, and a near and a far one in at most 3; two far ones are left to
other m. Hence a star around the smallest near member holds exactly the same connected pieces as all links at m: no
pairs within a group are made, however large it is. Links are deduplicated and verified by their bit count.

Before the ball is emitted, an exact sieve drops fingerprints that cannot have a partner: three bits lie in at most
three of six blocks of bits, so a partner agrees in three others, which 20 keys show.

Components come from rounds of hooking each node to its least neighbour (in natural order and in the order of ids
xor-ed with a constant, in turn: the first collapses stars, the second long chains) and contracting the links. Each round's
tables are written to the shared folder. Nothing is collected to the driver.

Defined cases: null, empty or blank text has fingerprint 0, which links like any other. Repeated rows each yield a
row. A null doc_id never becomes component_id unless its component holds nothing else. Columns other than the two
named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, as_bytes, release, unused, written

RADIUS = 3
SHINGLE = 3
_CHUNK = 1 << 18
_SALTS = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x38B34AE5A1E38B93, 0x7F4A7C15F39CC060)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([digest(line[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs and one more column: the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _signed([fingerprint(t) for t in as_bytes(b, text)])
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, name])

    return docs.mapInArrow(each, docs.withColumn(name, F.lit(0).cast("long")).schema)


def _sieve(fps: DataFrame) -> DataFrame:
    """The fingerprints that share three of six blocks of bits with another."""
    cuts = [0, 11, 22, 33, 44, 54, 64]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in of) for of in combinations(range(6), 3)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64)))) for k, m in enumerate(masks)]
    met = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = met.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("key")
    return met.join(shared, "key", "left_semi").select("fp").distinct()


def _masks() -> tuple[np.ndarray, np.ndarray]:
    one = [1 << i for i in range(64)]
    near = np.array([0, *one], np.uint64)
    far = np.array([one[i] | one[j] for i in range(64) for j in range(i) if i // 32 == j // 32], np.uint64)
    return near, far


def _balls(fps: DataFrame) -> DataFrame:
    """(m, fp, near): near holds fp again if m is within one bit of it, else null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = _masks()
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            odd = np.bitwise_count(all_fps) % 2 == 1
            for masks, of in ((near, all_fps), (far, all_fps[odd])):
                for at in range(0, len(of), 64):
                    some = of[at : at + 64]
                    m, fp = (some[:, None] ^ masks).ravel().view(np.int64), np.repeat(some.view(np.int64), len(masks))
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(fp), pa.array(fp, mask=np.full(len(fp), masks is far))], ["m", "fp", "near"])

    return fps.mapInArrow(each, "m long, fp long, near long")


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join what lies within RADIUS bits."""
    at_m = Window.partitionBy("m")  # a ball has at most 2081 members
    sieved = written(_sieve(fps), "sieved")
    release(fps.sparkSession)
    met = _balls(sieved).select("fp", F.min("near").over(at_m).alias("hub")).where("fp != hub")
    met = met.select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v")).distinct()
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (u, v): one of its nodes names each component."""
    links_ = Written(edges.where("u != v"), "links")
    labels, turn = None, 0
    while True:
        salt = F.lit(0 if turn % 2 == 0 else _SALTS[turn // 2 % len(_SALTS)]).cast("long")
        both = links_.df.unionByName(links_.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(salt)).alias("w"))
        hooks = Written(least.select(F.col("u").alias("node"), F.least("w", F.col("u").bitwiseXOR(salt)).bitwiseXOR(salt).alias("root")), "hooks")
        if labels is None:
            labels = hooks.df.select("node", F.col("root").alias("comp"))
        else:
            to = hooks.df.withColumnsRenamed({"node": "comp"})
            old, labels = labels, labels.join(to, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            del old
        labels = written(labels, "labels")
        a, b = (hooks.df.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "uv")
        shrunk = links_.df.join(a, "u").join(b, "v").where("ru != rv")
        shrunk = Written(shrunk.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        links_.drop()
        links_, turn = shrunk, turn + 1
        if links_.df.isEmpty():
            return labels


def components(doc_fps: DataFrame) -> DataFrame:
    """(fp, comp, component_id) for the distinct fingerprints of doc_fps (doc_id, fp); comp names the component."""
    least = written(doc_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    comp = connected_components(links(least.select("fp")))
    named = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    first = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return named.join(first, "comp").select("fp", "comp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = written(with_fingerprints(slim).select("doc_id", "fp"), "doc_fps")
    out = fps.join(components(fps), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all columns of docs; of repeated rows one."""
    fp, n = unused(docs, "fp"), unused(docs, "n")
    own = written(with_fingerprints(docs, name=fp), "with_fps")
    fps = own.select("doc_id", F.col(fp).alias("fp"))
    pairs = fps.distinct().join(components(fps), "fp")
    # of a component the fingerprints under its smallest doc_id; the least of them if that id has several
    kept = pairs.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp", "doc_id").agg(F.min("fp").alias("_fp"))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_fp"))
    found = own.join(kept, (own[fp] == kept["_fp"]) & own["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    first = Window.partitionBy(fp, "doc_id").orderBy(*(c for c, kind in docs.dtypes if kind in ("string", "bigint")))
    return found.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

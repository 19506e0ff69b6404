"""Mixing sources to target weights by entropy balancing (operator 8), in DataFrame functions only.

Targets. A source's size is the number of words in its texts. Sources, by code point and null last, weigh 3, 1, 2 and so
on again; together they share SHARE of all words. A target stops at CAP times its source's size, and the excess goes to
the others by weight until none is above: that is one water level, found from sums over the sources in the order in
which they fill.

Balancing. Of all document rates between 0 and CAP whose words meet a source's target, those closest to 1 in relative
entropy are min(CAP, exp(lambda * size / mean size)). The multiplier solves the convex dual; Newton steps for all
sources at once run as aggregations over the histogram of (source, size), as documents of one size share a rate. A
step that would leave the bracket around the root is replaced by a bisection.

Copies. In each source, sizes descending, a running sum of rates is rounded and differenced, so each size gets a whole
number of copies. What the rounding left over is then settled by a few greedy passes from large sizes to small; each at
least halves it, as long as documents that fit are left. Copies are dealt within a size by the order of a hash, in
SUBCELLS groups whose shares are again differences of a rounded prefix sum, so that no window holds a whole source.

Documents are taken whole. A source so misses its target by a few words as a rule, and at worst by half of its longest
document, where that makes up most of the source.

Defined cases: a null text has size 0; what has size 0 is never taken. Null sources form one source. Rows with the same
doc_id are ranked in any order. Other columns are ignored. An empty table gives an empty result. One window sees a row
for each source, one a row for each size of a source; both are bounded by the sources and the lengths of texts, not by rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, written

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SUBCELLS = 256
TOLERANCE, MOST_STEPS, PASSES = 1e-7, 60, 8


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (_key, source, source_size, n_docs), with target."""
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = Window.partitionBy(F.lit(1)).orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    limit = cap * F.col("source_size")
    found = sizes.withColumn("w", w.cast("double")).withColumn("full_at", limit / F.col("w"))
    full_before = F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    found = found.withColumn("level", (share * F.sum("source_size").over(everything) - full_before) / weight_left)
    found = found.withColumn("rank", F.row_number().over(fill))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rank", "level"))).over(everything)["level"]
    return found.withColumn("target", F.least(F.col("w") * level, limit.cast("double"))).withColumn("target", F.coalesce("target", limit.cast("double"))).drop("w", "full_at", "level", "rank")


def tilt(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """The sources with lam, at which the rates min(cap, exp(lam * size / mean)) meet the targets of cells (_key, _size, n)."""
    some = sources.where("source_size > 0")
    mean = F.col("source_size") / F.col("n_docs")
    state = some.select("_key", "source_size", "target", mean.alias("mean"), "least", F.lit(0.0).alias("lam"))
    slowest = F.col("mean") / F.col("least")
    state = state.withColumns({"hi": math.log(cap) * slowest, "lo": F.least(F.log(F.col("target") / F.col("source_size")), F.lit(0.0)) * slowest, "off": F.lit(1.0)})
    state = Written(state, "multipliers")
    for _ in range(MOST_STEPS):
        x = F.col("_size") / F.col("mean")
        # beyond the cap the exponent no longer matters, and must not overflow
        rate = F.exp(F.least(F.col("lam") * x, F.lit(math.log(cap))))
        free = (F.col("lam") * x < math.log(cap)).cast("double")
        words = F.col("n") * F.col("_size")
        sums = cells.join(state.df.select("_key", "mean", "lam"), "_key").groupBy("_key").agg(F.sum(words * rate).alias("f"), F.sum(words * rate * x * free).alias("slope"))
        step = state.df.join(sums, "_key").withColumns({"lo": F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        newton = F.when(F.col("slope") > 0, F.col("lam") - (F.col("f") - F.col("target")) / F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        off = F.abs(F.col("f") / F.col("target") - 1)
        step = step.withColumn("off", off).withColumn("lam", F.when(off <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)).select(*state.df.columns)
        step = Written(step, "multipliers")
        state.drop()
        state = step
        worst = state.df.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state.df.select("_key", "source_size", "target", "mean", F.round("lam", 7).alias("lam"))


def copies_by_size(cells: DataFrame, tilted: DataFrame, cap: int = CAP) -> DataFrame:
    """cells (_key, _size, n), with k: the copies that all documents of the cell get together."""
    within = Window.partitionBy("_key")
    down = within.orderBy(F.col("_size").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    rate = F.exp(F.least(F.col("lam") * F.col("_size") / F.col("mean"), F.lit(math.log(cap))))
    found = cells.join(tilted, "_key").withColumn("rate", F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(rate))
    found = found.withColumn("upto", F.floor(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    found = found.withColumn("k", F.greatest(F.lit(0), F.least(F.col("n") * cap, F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))))
    for _ in range(PASSES):
        found = found.withColumn("e", F.col("target") - F.sum(F.col("k") * F.col("_size")).over(within))
        room = F.when(F.col("_size") > F.abs("e"), 0).when(F.col("e") > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k"))
        found = found.withColumn("room", room)
        left = F.abs("e") - F.coalesce(F.sum(F.col("room") * F.col("_size")).over(before), F.lit(0))
        move = F.least(F.col("room"), F.greatest(F.lit(0), F.floor(left / F.col("_size"))))
        found = found.withColumn("k", (F.col("k") + F.signum("e") * move).cast("long"))
    return found.select("_key", "_size", "n", "k")


def with_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs (doc_id, source, _size and more) with _source_size, _target and _copies, a whole number up to cap."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))  # never null
    docs = docs.withColumns({"_key": key, "_sub": F.pmod(F.xxhash64("doc_id"), F.lit(SUBCELLS)).cast("int")})
    # one scan of the texts gives the histogram; everything up to the last join works on it
    subcells = written(docs.groupBy("_key", "source", "_size", "_sub").agg(F.count(F.lit(1)).alias("n_sub")), "subcells")
    cells = written(subcells.where("_size > 0").groupBy("_key", "_size").agg(F.sum("n_sub").alias("n")), "cells")
    worded = F.col("_size") > 0
    sizes = subcells.groupBy("_key", "source").agg(F.sum(F.col("_size") * F.col("n_sub")).alias("source_size"), F.sum(F.when(worded, F.col("n_sub"))).alias("n_docs"), F.min(F.when(worded, F.col("_size"))).alias("least"))
    sources = written(targets(sizes, weights, share, cap), "sources")
    k = copies_by_size(cells, tilt(cells, sources, cap), cap)
    shared = subcells.join(k, ["_key", "_size"]).withColumn("_upto", F.expr("k * sum(n_sub) OVER (PARTITION BY _key, _size ORDER BY _sub ROWS UNBOUNDED PRECEDING) div n"))
    of_cell = Window.partitionBy("_key", "_size").orderBy("_sub")
    shared = shared.select("_key", "_size", "_sub", "n_sub", (F.col("_upto") - F.coalesce(F.lag("_upto").over(of_cell), F.lit(0))).alias("_k"))
    shared = written(shared.withColumn("_least", F.expr("_k div n_sub")).withColumn("_more", F.col("_k") - F.col("_least") * F.col("n_sub")).drop("n_sub", "_k"), "shares")
    rank = F.row_number().over(Window.partitionBy("_key", "_size", "_sub").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id"))
    ranked = docs.join(shared, ["_key", "_size", "_sub"], "left").withColumn("_rank", rank)
    copies = F.coalesce(F.col("_least") + (F.col("_rank") <= F.col("_more")).cast("long"), F.lit(0).cast("long"))
    named = sources.select("_key", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    return ranked.withColumn("_copies", copies).drop("_sub", "_least", "_more", "_rank").join(named, "_key").drop("_key")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("_size")), "sizes")
    found = with_copies(slim)
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def repeat_by_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each row of docs as often as the mix takes it, with all columns of docs."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("_size"), F.struct(*docs.columns).alias("_row"))
    return with_copies(own).where("_copies > 0").select("_row", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Ranges of a total order: places of rows, and which ranges of keys rows or other ranges meet.

No task sees all rows. Keys are dealt to ranges between bounds that a fixed, bounded sample gives; what lies before a
range is known from a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are sampled for each range.
SAMPLE = 32
#: The most files whose ranges every task gets.
MAX_BROADCAST = 10_000


def bounds_of(keys: DataFrame, key: str, n_ranges: int | None = None) -> list[Column]:
    """Ascending literals that part the keys into ranges of about one size; the keys of least hash are the sample, so the
    same keys give the same bounds in every run."""
    n = n_ranges or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = keys.select(key).orderBy(F.xxhash64(key)).limit(n * SAMPLE)
    found = some.agg(F.array_sort(F.collect_set(key)).alias("all")).first()["all"]
    step = max(1, len(found) // n)
    kind = keys.schema[key].dataType
    return [F.lit(x).cast(kind) if not hasattr(kind, "fields") else F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, kind.fields, strict=True))) for x in found[step::step]]


def range_of(key: Column, bounds: list[Column]) -> Column:
    """How many bounds are not above the key, by bisection."""
    if not bounds:
        return F.lit(0)
    n, all_ = len(bounds), F.array(*bounds)

    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(all_, mid) <= key
        done = a["lo"] >= a["hi"]
        return F.struct(F.when(~done & below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(~done & ~below, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halved, lambda a: a["lo"])


def ranked(rows: DataFrame, by: list[Column | str], name: str = "place", n_ranges: int | None = None) -> DataFrame:
    """rows with their rank, from 1, in the order of `by`; equal ones share it. Equal keys count once before the shuffle."""
    keyed = rows.withColumn("_key", F.struct(*(F.col(c).alias(f"_{i}") if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(by))))
    distinct = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    dealt = distinct.withColumn("_range", range_of(F.col("_key"), bounds_of(keyed, "_key", n_ranges)))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("_n").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1))
    places = dealt.withColumn("_within", F.coalesce(within, F.lit(0))).join(sums, "_range").select("_key", (F.col("_before") + F.col("_within") + 1).alias(name))
    return keyed.join(places.withColumnRenamed("_key", "_placed"), F.col("_key").eqNullSafe(F.col("_placed"))).drop("_key", "_placed")


def inside(rows: DataFrame, ranges: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """The rows whose k lies in some range (smallest_k, largest_k). Few ranges go to every task; more of them are dealt
    with the rows, and the greatest end among the ranges that start at or before a key decides."""
    own = ranges.select("smallest_k", "largest_k")
    if own.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        few = F.broadcast(own)
        return rows.join(few, (few["smallest_k"] <= rows["k"]) & (rows["k"] <= few["largest_k"]), "left_semi")
    kind = rows.schema["k"].dataType
    bounds = bounds_of(own, "smallest_k", n_ranges)
    starts = own.select(F.col("smallest_k").cast(kind).alias("_at"), F.lit(0).alias("_last"), F.col("largest_k").alias("_end"))
    asked = rows.select("k").distinct().select(F.col("k").alias("_at"), F.lit(1).alias("_last"), F.lit(None).cast(ranges.schema["largest_k"].dataType).alias("_end"))
    dealt = starts.unionByName(asked).withColumn("_range", range_of(F.col("_at"), bounds))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = starts.withColumn("_range", range_of(F.col("_at"), bounds)).groupBy("_range").agg(F.max("_end").alias("_most"))
    ends = dealt.select("_range").distinct().join(ends, "_range", "left").select("_range", F.max("_most").over(before).alias("_carried"))
    within = F.max("_end").over(Window.partitionBy("_range").orderBy("_at", "_last").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_most", within).where("_last = 1").join(ends, "_range").where(F.greatest("_most", "_carried") >= F.col("_at"))
    return rows.join(met.select(F.col("_at").alias("k")), "k", "left_semi")


def overlaps(files: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """a, b: files (file_no, lo, hi) with overlapping ranges, a < b. Files meet in the range of the order that holds the
    later of their starts, so that each pair comes up once and only files near each other are compared."""
    bounds = bounds_of(files, "lo", n_ranges)
    dealt = files.select("file_no", "lo", "hi", F.explode(F.sequence(range_of(F.col("lo"), bounds), range_of(F.col("hi"), bounds))).alias("_range"))
    a, b = (dealt.select("_range", F.col("file_no").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in "ab")
    met = a.join(b, "_range").where("a < b AND a_lo <= b_hi AND b_lo <= a_hi")
    return met.where(F.col("_range") == range_of(F.greatest("a_lo", "b_lo"), bounds)).select("a", "b")

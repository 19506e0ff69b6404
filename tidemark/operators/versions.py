"""The read side of a change log (k, seq, op, v): plain DataFrame plans without storage.

The newest version of a key is found by aggregation where the payload has a fixed width, as that combines rows before
the shuffle in a hash table, else by a window that keeps one row a key on either side of the shuffle; neither gathers
the versions of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, MAX_SEQ, PUT

_VARIABLE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def checked(log: DataFrame) -> DataFrame:
    """log with problem: null for a row that can be, else the column that can't. Repair drops such
    rows, scans keep them."""
    seq = F.col("seq").isNull() | (F.col("seq") < 0) | (F.col("seq") > MAX_SEQ)
    op = F.col("op").isNull() | ~F.col("op").isin(DELETE, PUT)
    return log.withColumn("problem", F.when(F.col("k").isNull(), "k").when(seq, "seq").when(op, "op"))


def as_of(log: DataFrame, snapshot: int | None) -> DataFrame:
    """The rows that a snapshot sees; goes before anything that picks versions."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, by_window: bool | None = None) -> DataFrame:
    """The row with the largest seq of each key, deletions included."""
    if by_window is None:
        by_window = isinstance(log.schema["v"].dataType, _VARIABLE)
    if by_window:
        first = Window.partitionBy("k").orderBy(F.col("seq").desc())
        return log.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("k", "seq", "op", "v")
    # a null value must not let an older one through, which max_by over the bare column does not promise
    picked = log.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by(F.coalesce("v", _any_value(log.schema["v"].dataType)), "seq").alias("v"), F.max_by(F.col("v").isNull(), "seq").alias("_null"))
    return picked.select("k", "seq", "op", F.when(~F.col("_null"), F.col("v")).alias("v"))


def _any_value(kind: T.DataType) -> Column:
    return F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("1970-01-01").cast(kind) if isinstance(kind, (T.DateType, T.TimestampType)) else F.lit(False).cast(kind)


def visible(log: DataFrame, snapshot: int | None = None, by_window: bool | None = None) -> DataFrame:
    """The live keys at a snapshot: k, seq, v."""
    return newest(as_of(log, snapshot), by_window).where(F.col("op") == 1).select("k", "seq", "v")


def merged(*logs: DataFrame) -> DataFrame:
    """All rows of several runs."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return out


def history(log: DataFrame, key=None) -> DataFrame:
    """All versions by key, newest first, each with the version before and after it."""
    rows = log if key is None else log.where(F.col("k") == F.lit(key))
    down = Window.partitionBy("k").orderBy(F.col("seq").desc())
    return rows.select("k", "seq", "op", "v", F.lag("seq").over(down).alias("newer_seq"), F.lead("seq").over(down).alias("older_seq"))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """What differs between two snapshots: k, change (added, removed, changed), old_seq, new_seq."""
    a = visible(log, old).select("k", F.col("seq").alias("old_seq"), F.col("v").alias("old_v"))
    b = visible(log, new).select("k", F.col("seq").alias("new_seq"), F.col("v").alias("new_v"))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    differs = F.col("old_seq").isNull() | F.col("new_seq").isNull() | (F.col("old_seq") != F.col("new_seq"))
    return a.join(b, "k", "full_outer").where(differs).select("k", change.alias("change"), "old_seq", "new_seq", "old_v", "new_v")


def last(log: DataFrame) -> DataFrame:
    """last_seq of a log, and n_bytes of its keys as text."""
    return log.agg(F.max("seq").alias("last_seq"), F.sum(F.length(F.col("k").cast("string"))).alias("n_bytes"))


def order(rows: DataFrame, reverse: bool = False) -> DataFrame:
    """By key, and newest first where there are versions."""
    k = F.col("k").desc() if reverse else F.col("k").asc()
    return rows.orderBy(k, F.col("seq").desc()) if "seq" in rows.columns else rows.orderBy(k)

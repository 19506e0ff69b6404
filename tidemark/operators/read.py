"""Lookups and range scans over a change log. Bounds on the key stand below everything else, and so reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import successor
from .versions import visible


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """k, seq, v of one key; no row if it is absent or deleted."""
    return visible(log.where(F.col("k") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """A row for each distinct key of keys (k): seq and v are null if it is absent or deleted."""
    asked = keys.select("k").distinct()
    return asked.join(visible(log.join(asked, "k", "left_semi"), snapshot), "k", "left")


def between(log: DataFrame, start=None, end=None, inclusive: bool = False) -> DataFrame:
    """Rows with start < k <= end, or start <= k if inclusive; None is no bound."""
    if start is not None:
        log = log.where(F.col("k") >= F.lit(start) if inclusive else F.col("k") > F.lit(start))
    return log if end is None else log.where(F.col("k") <= F.lit(end))


def scan(log: DataFrame, start=None, end=None, snapshot: int | None = None, inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """The live keys above start in order."""
    found = visible(between(log, start, end, inclusive), snapshot).orderBy("k")
    return found if limit is None else found.limit(limit)


def reverse_scan(log: DataFrame, start=None, snapshot: int | None = None, inclusive: bool = False, limit: int | None = None) -> DataFrame:
    """The live keys below start, largest first; the newest version of each."""
    if start is not None:
        log = log.where(F.col("k") <= F.lit(start) if inclusive else F.col("k") < F.lit(start))
    found = visible(log, snapshot).orderBy(F.col("k").desc())
    return found if limit is None else found.limit(limit)


def prefix_scan(log: DataFrame, prefix: bytes | str, snapshot: int | None = None) -> DataFrame:
    """The live keys that begin with prefix, in order. The bounds are plain comparisons, which files can be pruned by."""
    if isinstance(prefix, str):
        end = successor(prefix.encode())
        bound = F.lit(True) if end is None else F.encode("k", "UTF-8") < F.lit(end)
        found = log.where((F.col("k") >= F.lit(prefix)) & bound)
    else:
        end = successor(prefix)
        found = log.where(F.col("k") >= F.lit(prefix))
        found = found if end is None else found.where(F.col("k") < F.lit(end))
    return visible(found, snapshot).orderBy("k")


def count(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """n: the number of live keys."""
    return visible(log, snapshot).agg(F.count(F.lit(1)).alias("n"))

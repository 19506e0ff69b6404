"""Compaction: which rows survive, which files are merged, and statistics that decide it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FileMeta, Options
from . import ranges
from .versions import newest


def compacted(log: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """The rows that must stay so that every snapshot from smallest_snapshot on reads the same.

    A row goes if the next newer one of its key has seq <= smallest_snapshot (rule A): so rows above it all stay, without
    a shuffle, and of the others the newest of each key. A deletion at or below it goes too (rule B), if no file of
    `deeper` (smallest_k, largest_k) can hold its key.
    """
    above = log.where(F.col("seq") > smallest_snapshot).select("k", "seq", "op", "v")
    old = newest(log.where(F.col("seq") <= smallest_snapshot))
    deletions = old.where("op = 0")
    if deeper is None:
        return above.unionByName(old.where("op != 0"))
    held = covered(deletions, deeper)
    return above.unionByName(old.where("op != 0")).unionByName(held)


def covered(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose key lies in some range (smallest_k, largest_k) of files."""
    return ranges.inside(rows, files)


def range_pairs(files: DataFrame) -> DataFrame:
    """a, b: files with overlapping key ranges, a < b. Files (file_no, lo, hi) of a manifest."""
    return ranges.overlaps(files)


def meeting(files: DataFrame, lo, hi) -> DataFrame:
    """The files (lo, hi) whose range meets [lo, hi]; None is no bound."""
    found = files if hi is None else files.where(F.col("lo") <= F.lit(hi))
    return found if lo is None else found.where(F.col("hi") >= F.lit(lo))


def key_range(files: DataFrame) -> DataFrame:
    """lo, hi of all files (lo, hi)."""
    return files.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def boundary_pairs(files: DataFrame) -> DataFrame:
    """file_no, next_file: files of a level of which the second begins with the key at which the first ends."""
    b = files.select("level", F.col("file_no").alias("next_file"), F.col("lo").alias("hi"))
    return files.select("level", "file_no", "hi").join(b, ["level", "hi"]).where("file_no != next_file").select("file_no", "next_file")


def level_summary(files: DataFrame) -> DataFrame:
    """level, n_files, n_bytes, smallest, largest."""
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"), F.min("smallest_k").alias("smallest"), F.max("largest_k").alias("largest"))


def level_scores(summary: DataFrame, options: Options = Options()) -> DataFrame:
    """level and score: files by the trigger on level 0, bytes by the budget elsewhere."""
    budget = F.lit(float(options.level_bytes)) * F.pow(F.lit(float(options.level_factor)), F.greatest(F.col("level") - 1, F.lit(0)))
    return summary.select("level", F.when(F.col("level") == 0, F.col("n_files") / F.lit(float(options.l0_trigger))).otherwise(F.col("n_bytes") / budget).alias("score"))


def best_level(scores: DataFrame) -> DataFrame:
    """The level of the largest score; the first of equals."""
    return scores.agg(F.min_by("level", F.struct(-F.col("score"), F.col("level"))).alias("level"), F.max("score").alias("score"))


# --- decisions of the driver over a manifest's files


def overlapping(files: Iterable[FileMeta], level: int, lo: bytes | None, hi: bytes | None) -> list[FileMeta]:
    """The files of a level that meet [lo, hi]; on level 0 the range grows with each, until nothing is added."""
    own = [f for f in files if f.level == level]
    while True:
        found = [f for f in own if f.overlaps(lo, hi)]
        if level or not found:
            return sorted(found, key=lambda f: (f.smallest_k, f.file_no))
        wide_lo = None if lo is None else min([lo, *(f.smallest_k for f in found)])
        wide_hi = None if hi is None else max([hi, *(f.largest_k for f in found)])
        if (wide_lo, wide_hi) == (lo, hi):
            return sorted(found, key=lambda f: f.file_no)
        lo, hi = wide_lo, wide_hi


def with_boundary_files(files: Iterable[FileMeta], chosen: list[FileMeta]) -> list[FileMeta]:
    """chosen, and files of the level that begin with the user key at which a chosen one ends: no key's versions part."""
    if not chosen:
        return chosen
    level = chosen[0].level
    out = {f.file_no: f for f in chosen}
    while True:
        ends = {f.largest_k for f in out.values()}
        more = [f for f in files if f.level == level and f.file_no not in out and f.smallest_k in ends]
        if not more:
            return sorted(out.values(), key=lambda f: (f.smallest_k, f.file_no))
        out |= {f.file_no: f for f in more}


def span(files: Iterable[FileMeta]) -> tuple[bytes, bytes]:
    files = list(files)
    return min(f.smallest_k for f in files), max(f.largest_k for f in files)


def scores(files: Iterable[FileMeta], options: Options) -> list[float]:
    """By level; the deepest has none."""
    files = list(files)
    out = []
    for level in range(options.levels - 1):
        own = [f for f in files if f.level == level]
        out.append(len(own) / options.l0_trigger if level == 0 else sum(f.size for f in own) / options.max_bytes(level))
    return out


def _meeting(files: list[FileMeta], level: int, others: list[FileMeta]) -> list[FileMeta]:
    """The files of a level that the range of others meets, without parting a key's versions."""
    return with_boundary_files(files, overlapping(files, level, *span(others)))


def input_sets(level: int, chosen: list[FileMeta], files: list[FileMeta], options: Options) -> tuple[list[FileMeta], list[FileMeta]]:
    """What is merged of a level and of the next. Of two candidates, the chosen files and all of their level that lie above
    the same files of the next, the second is taken if it is larger, stays below the limit and draws in nothing more."""
    own = with_boundary_files(files, chosen)
    candidates = [(own, _meeting(files, level + 1, own))]
    if candidates[0][1]:
        wide = _meeting(files, level, own + candidates[0][1])
        candidates.append((wide, _meeting(files, level + 1, wide)))

    def allowed(upper: list[FileMeta], lower: list[FileMeta]) -> bool:
        small = sum(f.size for f in upper + lower) < options.expand_factor * options.max_file_size
        return small and len(upper) > len(own) and len(lower) == len(candidates[0][1])

    return next((c for c in candidates[1:] if allowed(*c)), candidates[0])


def split_keys(grandparents: list[FileMeta], options: Options) -> list[bytes]:
    """Keys after which an output ends, so that none lies above more than the limit of the files two levels down."""
    limit, n, out = options.grandparent_factor * options.max_file_size, 0, []
    for f in sorted(grandparents, key=lambda f: f.largest_k):
        n += f.size
        if n > limit:
            out.append(f.largest_k)
            n = 0
    return out


class Compaction:
    """Inputs of a level and of the next, and the files one deeper that an output should not meet too many of."""

    def __init__(self, level: int, inputs: list[FileMeta], files: list[FileMeta], options: Options):
        self.level, self.options = level, options
        self.inputs, self.lower = input_sets(level, inputs, files, options)
        self.pointer = span(self.inputs)[1]
        self.grandparents = overlapping(files, level + 2, *span(self.inputs + self.lower)) if level + 2 < options.levels else []
        # files that may hold older versions of a key, below the output's level
        self.deeper = [f for f in files if f.level > level + 1]

    @property
    def is_trivial(self) -> bool:
        """One file, nothing to merge with, and not too much below: it only changes its level."""
        limit = self.options.grandparent_factor * self.options.max_file_size
        return len(self.inputs) == 1 and not self.lower and sum(f.size for f in self.grandparents) <= limit


def pick(files: list[FileMeta], pointers: dict[int, bytes], options: Options) -> Compaction | None:
    """The most urgent compaction, or None. Within a level files take turns by key."""
    by_level = scores(files, options)
    level = max(range(len(by_level)), key=lambda i: (by_level[i], -i))
    if by_level[level] < 1:
        return None
    own = sorted((f for f in files if f.level == level), key=lambda f: (f.smallest_k, f.file_no))
    after = pointers.get(level)
    first = next((f for f in own if after is None or f.largest_k > after), own[0])
    inputs = [first] if level else overlapping(files, 0, first.smallest_k, first.largest_k)
    return Compaction(level, inputs, files, options)


def flush_level(files: list[FileMeta], lo: bytes, hi: bytes, size: int, options: Options) -> int:
    """The level for a flushed file: it sinks to just above the first level that blocks it, at most max_flush_level. A level
    blocks that has files in the way, or that lies above too much of them."""
    met = [sum(f.size for f in overlapping(files, level, lo, hi)) for level in range(options.levels)]
    too_much = options.grandparent_factor * options.max_file_size
    blocked = [level for level, n in enumerate(met) if n or (level and sum(met[level + 1 : level + 2]) > too_much)]
    return max(0, min([options.max_flush_level + 1, *blocked]) - 1)


def applied(base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """A version of the manifest after an edit: (base and added) without deleted, by level and file_no."""
    return base.unionByName(added).join(deleted.select("level", "file_no").distinct(), ["level", "file_no"], "left_anti")


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.join(present.select("file_no").distinct(), "file_no", "left_anti")


def obsolete_files(present: DataFrame, live: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    kept = live.select("file_no") if pending is None else live.select("file_no").unionByName(pending.select("file_no"))
    return present.join(kept.distinct(), "file_no", "left_anti")


def table_stats(rows: DataFrame, file: str = "file") -> DataFrame:
    """n_rows, smallest_k, largest_k, min_seq, max_seq of each file."""
    return rows.groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("smallest_k"), F.max("k").alias("largest_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def amplification(log: DataFrame) -> DataFrame:
    """n_rows, n_keys, n_deletions and n_bytes of a log."""
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("k").alias("n_keys"), F.count(F.when(F.col("op") == 0, 1)).alias("n_deletions"))

"""Sorted Parquet tables of a change log: writing them with their key ranges, and reading those that a range needs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG, FileMeta, Options
from ..operators import ranges
from ..operators.compaction import table_stats
from .files import Folder

TABLES, MADE, DEAD = "tables", "_made", "_dead"


def files_in(folder: Folder, part: str) -> list[str]:
    """The Parquet files of one write."""
    place = f"{TABLES}/{part}"
    cells = [f"{place}/{x}" for x in folder.list(place) if x.startswith("_cell=")]
    return [f"{p}/{x}" for p in [place, *cells] for x in folder.list(p) if x.startswith("part-") and x.endswith(".parquet")]


def mark_dead(folder: Folder, paths: Sequence[str]) -> None:
    """Note tables, or folders of them, that no version will list again."""
    if paths:
        folder.make(DEAD)
        folder.create(f"{DEAD}/{uuid.uuid4().hex}", "\n".join(paths).encode())


def dead(folder: Folder) -> set[str]:
    return {x for name in folder.list(DEAD) for x in folder.read(f"{DEAD}/{name}").decode().split("\n")}


def write(log: DataFrame, folder: Folder, level: int, first_no: int, n_files: int, options: Options, split: Sequence[bytes] = ()) -> list[FileMeta]:
    """log in files by key range, each sorted by (k, seq descending); all versions of a key are in one file. No file has
    keys on both sides of a split key, which belongs to the lower side."""
    place = f"{TABLES}/{uuid.uuid4().hex}"
    rows = log.select(*LOG.names)
    if split:
        # each part of the key space between two split keys has files of its own
        cell = ranges.range_of(F.col("k"), [F.lit(x + b"\0") for x in split])
        rows = rows.withColumn("_cell", cell).repartitionByRange(max(n_files, len(split) + 1), "_cell", "k").sortWithinPartitions("_cell", "k", F.col("seq").desc())
        out = rows.write.partitionBy("_cell")
    else:
        rows = rows.repartitionByRange(n_files, "k") if n_files > 1 else rows.coalesce(1)
        out = rows.sortWithinPartitions("k", F.col("seq").desc()).write
    out = out.option("compression", "zstd")
    if options.bloom_on_key:
        out = out.option("parquet.bloom.filter.enabled#k", "true")
    out.parquet(folder.full(place))
    places = [f"{place}/{x}" for x in folder.list(place) if x.startswith("_cell=")] if split else [place]
    made = described(log.sparkSession, folder, [f"{p}/{x}" for p in places for x in folder.list(p) if x.startswith("part-")], level, first_no)
    # repair takes no table without it: it says that the write came to its end
    folder.create(f"{place}/{MADE}", "\n".join(f.path for f in made).encode())
    return made


def described(spark: SparkSession, folder: Folder, paths: list[str], level: int, first_no: int) -> list[FileMeta]:
    """describe() from the files' footers where these say all, so that no row is read."""
    jvm, conf, stats = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(folder.full(path)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        try:
            for block in reader.getFooter().getBlocks():
                own = {c.getPath().toDotString(): c.getStatistics() for c in block.getColumns()}
                if not all(own[c].hasNonNullValue() for c in ("k", "seq")):
                    return describe(spark, folder, paths, level, first_no)
                stats.append((path, block.getRowCount(), bytes(own["k"].getMinBytes()), bytes(own["k"].getMaxBytes()), own["seq"].getMin(), own["seq"].getMax()))
        finally:
            reader.close()
    files = []
    for path in sorted({x[0] for x in stats}):
        rows = list(zip(*(x[1:] for x in stats if x[0] == path), strict=True))
        files.append((path, sum(rows[0]), min(rows[1]), max(rows[2]), min(rows[3]), max(rows[4])))
    files.sort(key=lambda x: x[2])
    return [FileMeta(level, first_no + i, path, folder.size(path), *rest) for i, (path, *rest) in enumerate(files)]


def describe(spark: SparkSession, folder: Folder, paths: list[str], level: int, first_no: int) -> list[FileMeta]:
    """Key range and versions of files, without those that have no rows; a row for each comes to the driver."""
    if not paths:
        return []
    rows = spark.read.schema(LOG).parquet(*map(folder.full, paths)).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), f"/{TABLES}/"), -1))
    stats = sorted(table_stats(rows).collect(), key=lambda r: bytes(r["smallest_k"]))
    return [
        FileMeta(level, first_no + i, f"{TABLES}/{r['file']}", folder.size(f"{TABLES}/{r['file']}"), r["n_rows"], bytes(r["smallest_k"]), bytes(r["largest_k"]), r["min_seq"], r["max_seq"])
        for i, r in enumerate(stats)
    ]


def read(spark: SparkSession, folder: Folder, files: Iterable[FileMeta]) -> DataFrame:
    paths = [folder.full(f.path) for f in files]
    return spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)


def needed(files: Iterable[FileMeta], lo: bytes | None, hi: bytes | None, snapshot: int | None) -> list[FileMeta]:
    """The files that may hold visible rows with lo <= k <= hi: the others are never opened."""
    return [f for f in files if f.overlaps(lo, hi) and (snapshot is None or f.min_seq <= snapshot)]

"""Queries over the test tables, one for each operator, and SQL that says what they compute.

The change log is `events`: k = user_id, seq = event_id, op = 0 for clicks (deletions) and 1 for the rest, v = value.
`customer`, `orders`, `part`, `nation` and `lineitem` serve as keyspaces with one version a key, or with repeated keys.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, keys
from ..model import LOG
from ..operators import batch as B
from ..operators import compaction as C
from ..operators import ranges
from ..operators import read as R
from ..operators import versions as V
from ..sources.store import Store
from ..streaming.ingest import change_feed, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

S1, S2, KEY = 3000, 5000, 17
T = "(SELECT user_id k, event_id seq, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END op, value v FROM events)"


def newest_sql(where: str = "true", source: str = T) -> str:
    return f"(SELECT k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) n FROM {source} t WHERE {where}) WHERE n = 1)"


def visible_sql(where: str = "true", source: str = T) -> str:
    return f"(SELECT k, seq, v FROM {newest_sql(where, source)} WHERE op = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", 0).otherwise(1)
    return table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), F.col("value").alias("v"))


def names_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("k"), F.col("c_custkey").alias("seq"), F.lit(1).alias("op"), F.col("c_acctbal").alias("v"))


NAMES = "(SELECT c_name k, c_custkey seq, 1 op, c_acctbal v FROM customer)"

# --- reading


@query(f"SELECT * FROM {visible_sql()}")
def latest_live(spark, d):
    return V.visible(events_log(spark, d))


@query(f"SELECT * FROM {visible_sql()}")
def latest_by_window(spark, d):
    return V.visible(events_log(spark, d), by_window=True)


@query(f"SELECT * FROM {newest_sql()}")
def newest_with_deletions(spark, d):
    return V.newest(events_log(spark, d))


@query(f"SELECT * FROM {visible_sql(f'seq <= {S2}')}")
def snapshot(spark, d):
    return V.visible(events_log(spark, d), S2)


@query(f"SELECT * FROM {visible_sql(f'k = {KEY}')}")
def get_point(spark, d):
    return R.get(events_log(spark, d), KEY)


@query(f"SELECT * FROM {visible_sql(f'k = {KEY} AND seq <= {S1}')}")
def get_at_snapshot(spark, d):
    return R.get(events_log(spark, d), KEY, S1)


@query(f"SELECT a.k, b.seq, b.v FROM (SELECT DISTINCT c_custkey k FROM customer) a LEFT JOIN {visible_sql()} b ON a.k = b.k")
def multi_get(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return R.multi_get(events_log(spark, d), asked)


@query("SELECT c_name k, c_custkey seq, c_acctbal v FROM customer WHERE c_name > 'Customer#000000100' AND c_name <= 'Customer#000000300'")
def scan_after_start(spark, d):
    return R.scan(names_log(spark, d), "Customer#000000100", "Customer#000000300")


@query("SELECT c_name k, c_custkey seq, c_acctbal v FROM customer WHERE c_name >= 'Customer#000000100' AND c_name <= 'Customer#000000300'")
def scan_from_start(spark, d):
    return R.scan(names_log(spark, d), "Customer#000000100", "Customer#000000300", inclusive=True)


@query(f"SELECT * FROM {visible_sql('k < 100')} ORDER BY k DESC LIMIT 10")
def reverse_top(spark, d):
    return R.reverse_scan(events_log(spark, d), 100, limit=10)


@query(f"SELECT * FROM {visible_sql('k <= 100')}")
def reverse_inclusive(spark, d):
    return R.reverse_scan(events_log(spark, d), 100, inclusive=True)


@query(f"SELECT * FROM {visible_sql('k > 20')} ORDER BY k LIMIT 15")
def scan_limit(spark, d):
    return R.scan(events_log(spark, d), 20, limit=15)


@query("SELECT c_name k, c_custkey seq, c_acctbal v FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_scan(spark, d):
    return R.prefix_scan(names_log(spark, d), "Customer#00000001")


@query(f"SELECT count(*) n FROM {visible_sql()}")
def count_live(spark, d):
    return R.count(events_log(spark, d))


@query(f"SELECT count(*) n FROM {visible_sql(f'seq <= {S2}')}")
def count_at_snapshot(spark, d):
    return R.count(events_log(spark, d), S2)


@query(f"SELECT k, seq, op, v, lag(seq) OVER w newer_seq, lead(seq) OVER w older_seq FROM {T} t WINDOW w AS (PARTITION BY k ORDER BY seq DESC)")
def version_history(spark, d):
    return V.history(events_log(spark, d))


@query(
    f"""SELECT coalesce(a.k, b.k) k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END change,
    a.seq old_seq, b.seq new_seq, a.v old_v, b.v new_v FROM {visible_sql(f'seq <= {S1}')} a FULL JOIN {visible_sql(f'seq <= {S2}')} b ON a.k = b.k
    WHERE a.k IS NULL OR b.k IS NULL OR a.seq <> b.seq"""
)
def snapshot_diff(spark, d):
    return V.diff(events_log(spark, d), S1, S2)


@query(f"SELECT * FROM {visible_sql()}")
def merge_runs(spark, d):
    log = events_log(spark, d)
    return V.visible(V.merged(*(log.where(f"seq % 3 = {i}") for i in range(3))))


@query(f"SELECT row_number() OVER (ORDER BY k, seq DESC) place, k, seq FROM {T}")
def internal_order(spark, d):
    return ranges.ranked(events_log(spark, d), ["k", -F.col("seq")]).select("place", "k", "seq")


@query(f"SELECT k, seq FROM {T} ORDER BY k, seq DESC LIMIT 40")
def first_in_order(spark, d):
    return V.order(events_log(spark, d)).limit(40).select("k", "seq")


@query(f"SELECT * FROM {visible_sql()}")
def sql_view(spark, d):
    V.visible(events_log(spark, d)).createOrReplaceTempView("tidemark_live")
    return spark.sql("SELECT k, seq, v FROM tidemark_live")


# --- writing


@query(
    """SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) n FROM
    (SELECT l_orderkey k, 1000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) seq, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END op, l_extendedprice v FROM lineitem))
    WHERE n = 1 AND op = 1"""
)
def batch_order(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    rows = table(spark, d, "lineitem").withColumns({"k": F.col("l_orderkey"), "op": F.when(F.col("l_returnflag") == "R", 0).otherwise(1), "v": F.col("l_extendedprice")})
    return V.visible(B.with_versions(B.dealt(rows, order), 1000, order))


@query(
    """SELECT commit_group, count(*) n_ops, CAST(sum(n_bytes) AS BIGINT) n_bytes, min(seq) first_seq, max(seq) last_seq FROM (SELECT event_id seq, length(props) + 8 n_bytes,
    CAST(floor(sum(length(props) + 8) OVER (ORDER BY event_id) / 10000.0) AS BIGINT) commit_group FROM events) GROUP BY commit_group"""
)
def group_commit(spark, d):
    ops = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.length("props") + 8).cast("long").alias("n_bytes"))
    return B.group_sizes(ops, 10000).groupBy("commit_group").agg(F.count(F.lit(1)).alias("n_ops"), F.sum("n_bytes").alias("n_bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# --- compaction

_LAG = f"(SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) newer FROM {T} t)"
_RULE_A = f"(newer IS NULL OR newer > {S2})"
_DEEPER = "(SELECT n_nationkey * 6 lo, n_nationkey * 6 + 2 hi FROM nation)"


@query(f"SELECT k, seq, op, v FROM {_LAG} WHERE {_RULE_A} AND NOT (op = 0 AND seq <= {S2})")
def compaction(spark, d):
    return C.compacted(events_log(spark, d), S2)


@query(f"SELECT k, seq, op, v FROM {_LAG} x WHERE {_RULE_A} AND NOT (op = 0 AND seq <= {S2} AND NOT EXISTS (SELECT 1 FROM {_DEEPER} f WHERE f.lo <= x.k AND x.k <= f.hi))")
def compaction_over_deeper(spark, d):
    deeper = table(spark, d, "nation").select((F.col("n_nationkey") * 6).cast("long").alias("smallest_k"), (F.col("n_nationkey") * 6 + 2).cast("long").alias("largest_k"))
    return C.compacted(events_log(spark, d), S2, deeper)


@query(f"SELECT CAST({S2} AS BIGINT) s, k, seq, v FROM {visible_sql(f'seq <= {S2}')} UNION ALL SELECT CAST({S2 + 2000} AS BIGINT), k, seq, v FROM {visible_sql(f'seq <= {S2 + 2000}')}")
def compaction_preserves(spark, d):
    left = C.compacted(events_log(spark, d), S2)
    at = [V.visible(left, s).select(F.lit(s).cast("long").alias("s"), "k", "seq", "v") for s in (S2, S2 + 2000)]
    return at[0].unionByName(at[1])


@query(f"SELECT x.k FROM {newest_sql()} x WHERE op = 0 AND NOT EXISTS (SELECT 1 FROM {_DEEPER} f WHERE f.lo <= x.k AND x.k <= f.hi)")
def deletions_to_drop(spark, d):
    deleted = V.newest(events_log(spark, d)).where("op = 0")
    deeper = table(spark, d, "nation").select((F.col("n_nationkey") * 6).cast("long").alias("smallest_k"), (F.col("n_nationkey") * 6 + 2).cast("long").alias("largest_k"))
    return deleted.join(C.covered(deleted, deeper).select("k"), "k", "left_anti").select("k")


@query(f"SELECT count(*) n_rows, count(DISTINCT k) n_keys, count(*) FILTER (op = 0) n_deletions FROM {T}")
def amplification(spark, d):
    return C.amplification(events_log(spark, d))


# synthetic tables of a manifest: 500 versions each, seven levels in turn
_FILES = f"(SELECT CAST(floor(seq / 500.0) AS BIGINT) file_no, CAST(floor(seq / 500.0) AS BIGINT) % 7 AS level, count(*) n_rows, min(k) lo, max(k) hi, min(seq) min_seq, max(seq) max_seq, count(*) * 100000 size FROM {T} GROUP BY ALL)"


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    no = F.floor(F.col("seq") / 500.0).cast("long")
    rows = C.table_stats(events_log(spark, d).withColumn("file_no", no), "file_no")
    return rows.select("file_no", (F.col("file_no") % 7).alias("level"), "n_rows", F.col("smallest_k").alias("lo"), F.col("largest_k").alias("hi"), "min_seq", "max_seq", (F.col("n_rows") * 100000).alias("size"))


@query(f"SELECT * FROM {_FILES}")
def table_stats(spark, d):
    return manifest_files(spark, d)


@query(f"SELECT level, count(*) n_files, CAST(sum(size) AS BIGINT) n_bytes, min(lo) smallest, max(hi) largest FROM {_FILES} GROUP BY level")
def level_summary(spark, d):
    return C.level_summary(manifest_files(spark, d).withColumnsRenamed({"lo": "smallest_k", "hi": "largest_k"}))


_SCORES = f"(SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(size) / (10485760.0 * pow(10, greatest(level - 1, 0))) END::DOUBLE score FROM {_FILES} GROUP BY level)"


@query(f"SELECT level, round(score, 9) score FROM {_SCORES}")
def level_scores(spark, d):
    summary = C.level_summary(manifest_files(spark, d).withColumnsRenamed({"lo": "smallest_k", "hi": "largest_k"}))
    return C.level_scores(summary).select("level", F.round("score", 9).alias("score"))


@query(f"SELECT level, round(score, 9) score FROM {_SCORES} ORDER BY score DESC, level LIMIT 1")
def level_to_compact(spark, d):
    summary = C.level_summary(manifest_files(spark, d).withColumnsRenamed({"lo": "smallest_k", "hi": "largest_k"}))
    return C.best_level(C.level_scores(summary)).select("level", F.round("score", 9).alias("score"))


@query(f"SELECT a.file_no a, b.file_no b FROM {_FILES} a JOIN {_FILES} b ON a.file_no < b.file_no AND a.lo <= b.hi AND b.lo <= a.hi")
def file_overlap(spark, d):
    return C.range_pairs(manifest_files(spark, d))


@query(f"SELECT file_no, lo, hi FROM {_FILES} WHERE lo <= 3 AND hi >= 3")
def file_prune(spark, d):
    return C.meeting(manifest_files(spark, d), 3, 3).select("file_no", "lo", "hi")


@query(f"SELECT file_no, level, n_rows FROM {_FILES} WHERE file_no % 10 <> 3")
def manifest_apply(spark, d):
    files = manifest_files(spark, d).select("file_no", "level", "n_rows")
    return C.applied(files.where("file_no % 2 = 0"), files.where("file_no % 2 = 1"), files.where("file_no % 10 = 3"))


@query(f"SELECT 'missing' AS kind, file_no FROM {_FILES} WHERE file_no % 4 = 1 UNION ALL SELECT 'obsolete', file_no FROM {_FILES} WHERE file_no % 4 = 0 AND file_no % 3 <> 0")
def missing_and_obsolete(spark, d):
    files = manifest_files(spark, d).select("file_no")
    present, live = files.where("file_no % 4 <> 1"), files.where("file_no % 4 <> 0")
    gone = C.obsolete_files(present, live, files.where("file_no % 3 = 0")).select(F.lit("obsolete").alias("kind"), "file_no")
    return C.missing_files(files, present).select(F.lit("missing").alias("kind"), "file_no").unionByName(gone)


# files of one level, of which some end with the key that the next begins with
_TOUCHING = "(SELECT n_nationkey file_no, 1 AS level, n_nationkey * 10 lo, n_nationkey * 10 + CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 10 END hi FROM nation)"


@query(f"SELECT a.file_no, b.file_no AS next_file FROM {_TOUCHING} a JOIN {_TOUCHING} b ON b.level = a.level AND b.file_no <> a.file_no AND b.lo = a.hi")
def boundary_files(spark, d):
    no = F.col("n_nationkey")
    return C.boundary_pairs(table(spark, d, "nation").select(no.alias("file_no"), F.lit(1).alias("level"), (no * 10).alias("lo"), (no * 10 + F.when(no % 3 == 0, 5).otherwise(10)).alias("hi")))


@query(f"SELECT min(lo) lo, max(hi) hi FROM {_FILES} WHERE level IN (1, 2)")
def key_range(spark, d):
    return C.key_range(manifest_files(spark, d).where("level IN (1, 2)"))


@query("SELECT CASE WHEN event_id < 0 OR event_id % 11 = 0 THEN 'seq' WHEN event_type = 'error' THEN 'op' ELSE 'well formed' END AS found, count(*) n FROM events GROUP BY ALL")
def malformed_rows(spark, d):
    """Rows of a damaged log: a seq that can't be, or an operation that is neither put nor delete."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("seq"), F.when(F.col("event_type") == "error", 7).otherwise(1).alias("op"), F.col("value").alias("v"))
    return V.checked(rows).groupBy(F.coalesce("problem", F.lit("well formed")).alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT max(seq) last_seq, CAST(sum(length(k::VARCHAR)) AS BIGINT) n_bytes FROM {T}")
def last_version(spark, d):
    return V.last(events_log(spark, d))


# --- functions


@query("SELECT c_custkey, hex(encode(c_name)) hex_key, rank() OVER (ORDER BY encode(c_name)) place FROM customer")
def binary_order(spark, d):
    named = table(spark, d, "customer").select("c_custkey", keys.text_key("c_name").alias("b"))
    return ranges.ranked(named, ["b"]).select("c_custkey", F.hex("b").alias("hex_key"), "place")


@query("SELECT event_id, rank() OVER (ORDER BY event_id - 5000) by_long, rank() OVER (ORDER BY value - 50) by_double FROM events")
def number_key_order(spark, d):
    rows = table(spark, d, "events").select("event_id", keys.long_key(F.col("event_id") - 5000).alias("a"), keys.double_key(F.col("value") - 50).alias("b"))
    by_double = ranges.ranked(rows, ["b"], "by_double").select("event_id", "by_double")
    return ranges.ranked(rows, ["a"], "by_long").select("event_id", "by_long").join(by_double, "event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'log' WHEN c_custkey % 3 = 1 THEN 'table' ELSE 'MANIFEST' END kind, c_custkey number FROM customer")
def file_names(spark, d):
    no = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(no, F.lit(".log"))).when(F.col("c_custkey") % 3 == 1, F.concat(no, F.lit(".ldb"))).otherwise(F.concat(F.lit("MANIFEST-"), no))
    return table(spark, d, "customer").select("c_custkey", codec.file_kind(name).alias("kind"), F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("number"))


@query("SELECT count(DISTINCT c_custkey) n_found, true AS few_others FROM customer")
def bloom_filter(spark, d):
    """Keys that are in the filter, of which none is missed, and as many that are not, of which at most a fiftieth passes."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = own.count()
    asked = own.unionByName(own.select((F.col("k") + 1_000_000_007).alias("k")))
    found = codec.bloom_may_have(asked, codec.bloom_bits(own, expected=n), expected=n)
    present, absent = F.col("k") < 1_000_000_007, F.col("k") >= 1_000_000_007
    return found.agg(F.count(F.when(present & F.col("may_have"), 1)).alias("n_found"), (F.count(F.when(absent & F.col("may_have"), 1)) * 50 <= F.count(F.when(absent, 1))).alias("few_others"))


@query("SELECT o_orderkey, (o_orderkey >> 3) & 1 AS bit, o_orderkey | 32 AS with_bit FROM orders")
def bits(spark, d):
    c = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", codec.get_bit(c, F.lit(3)).cast("long").alias("bit"), codec.set_bit(c, F.lit(5)).alias("with_bit"))


@query("SELECT c_custkey, hex(encode(c_name || '/' || c_mktsegment)) AS joined, hex(encode(substr(c_name, 10, 4))) AS part, strlen(c_name) AS n, c_name < c_mktsegment AS smaller FROM customer")
def byte_functions(spark, d):
    a, b = keys.text_key("c_name"), keys.text_key("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.hex(F.concat(a, F.lit(b"/"), b)).alias("joined"), F.hex(F.substring(a, 10, 4)).alias("part"), F.octet_length(a).cast("long").alias("n"), (a < b).alias("smaller"))


# the checksum bit by bit: polynomial 0xEDB88320, reflected
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(c_name)), 2 * i - 1, 2))::BIGINT for i in range(1, strlen(c_name) + 1)]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


@query(f"SELECT c_custkey, {_CRC} AS crc FROM customer")
def checksums(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.crc32(keys.text_key("c_name")).alias("crc"))


@query()
def hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.xxhash64("c_name").alias("hash"))


# --- the store end to end


def _new_store(spark: SparkSession):
    """An empty store in the shared folder of the cluster, or in a temporary one on a single machine; it goes when this
    process ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-store-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    store = Store.open(spark, f"{folder}/tidemark-store-{uuid.uuid4().hex}", auto_compact=False)
    atexit.register(_removed, store)
    return store


def _removed(store: Store) -> None:
    try:
        store.folder.delete("")
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def _ops(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "click", 0).otherwise(1)
    return events.select(keys.long_key("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == 1, F.encode(F.col("value").cast("string"), "UTF-8")).alias("v"))


def _filled(spark: SparkSession, d: str) -> Store:
    store, ops = _new_store(spark), _ops(table(spark, d, "events"))
    for i in range(3):
        store.write_frame(ops.where(f"seq % 3 = {i}"), ["seq"], n_files=2)
    return store


_STORED = "(SELECT k, row_number() OVER (ORDER BY seq % 3, seq) seq, op, v FROM {T} t)".format(T=T)


def _shown(rows: DataFrame) -> DataFrame:
    k = F.conv(F.hex("k"), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return rows.select(k.alias("k"), "seq", F.round(F.decode("v", "UTF-8").cast("double"), 6).alias("v"))


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql('true', _STORED)}")
def store_iterator(spark, d):
    with _filled(spark, d) as store:
        return _shown(store.iterator())


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql('true', _STORED)}")
def store_after_compaction(spark, d):
    with _filled(spark, d) as store:
        store.compact_range()
        return _shown(store.iterator())


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql(f'seq <= {S1}', _STORED)}")
def store_snapshot_over_compaction(spark, d):
    with _filled(spark, d) as store:
        store.snapshots.take(S1)
        store.compact_range()
        return _shown(store.iterator(snapshot=S1))


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql('true', _STORED)} WHERE k > 20 ORDER BY k LIMIT 25")
def store_scan_limit(spark, d):
    with _filled(spark, d) as store:
        return _shown(store.iterator(start=keys.as_key(20), limit=25))


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql('true', _STORED)} WHERE k < 20")
def store_reverse(spark, d):
    with _filled(spark, d) as store:
        return _shown(store.iterator(start=keys.as_key(20), reverse=True))


@query("SELECT * FROM (VALUES ('info', 0), ('lock', 1), ('log', 1), ('other', 3)) t(kind, n) WHERE n > 0")
def directory(spark, d):
    """A store's folder: one lock and one log; the folders of commits, tables and marks are no files of a store."""
    store = _filled(spark, d)
    try:
        store.folder.make("_stream")
        found = store.folder.names()
        return found.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    finally:
        store.close()


@query(f"SELECT a.k, b.seq, round(b.v, 6) v FROM (SELECT DISTINCT n_nationkey::BIGINT k FROM nation) a LEFT JOIN {visible_sql('true', _STORED)} b USING (k)")
def store_multi_get(spark, d):
    asked = table(spark, d, "nation").select(keys.long_key("n_nationkey").alias("k"))
    with _filled(spark, d) as store:
        return _shown(store.multi_get(asked))


@query(f"SELECT k, seq, round(v, 6) v FROM {visible_sql('true', T.replace('event_id seq', 'row_number() OVER (ORDER BY event_id) seq'))}")
def stream_ingest(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    with _new_store(spark) as store:
        ingest(store, _ops(events), ["seq"], f"{store.folder.path}/_stream", name=f"ingest-{uuid.uuid4().hex}", once=True).awaitTermination()
        return _shown(store.iterator())


@query(f"SELECT k, seq, round(v, 6) v FROM {_STORED} WHERE op = 1")
def change_feed_rows(spark, d):
    """The rows that a feed of the store's commits brings, before and after a compaction: each once."""
    with _filled(spark, d) as store:
        out = f"{store.folder.path}/_feed"
        for i in range(2):
            change_feed(store, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/{n}"), f"{store.folder.path}/_fed", name=f"feed-{uuid.uuid4().hex}", once=True).awaitTermination()
            if not i:
                store.compact_range()
        return _shown(spark.read.option("recursiveFileLookup", "true").schema(LOG).parquet(out).where("op = 1"))

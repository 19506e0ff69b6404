"""The store end to end."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark import Store, StoreError, WriteBatch, repair
from tidemark.sources.lock import LockFailed
from tidemark.sources.manifest import Conflict, Edit
from tidemark.streaming.ingest import ingest


def live(store, **scan):
    return [(bytes(r.k), bytes(r.v)) for r in store.iterator(**scan).collect()]


def test_put_get_delete(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.put("key", "world")
        s.put("key1", "world1")
        s.put("key", "world2")
        s.delete("key1")
        s.delete("absent")
        s.put("empty", "")
        assert s.get("key") == b"world2" and s.get("key1") is None and s.get("absent") is None and s.get("empty") == b""
        s.compact_range()
        assert s.get("key") == b"world2" and s.get("key1") is None and s.get("empty") == b""
        assert live(s) == [(b"empty", b""), (b"key", b"world2")]


def test_overwrites_and_deletes_in_turn(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        for v in ("value1", "value2", None, "value3", "value4"):
            s.put("key", v) if v else s.delete("key")
            s.flush()
        assert s.get("key") == b"value4"


def test_batch_is_ordered(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        b = WriteBatch()
        for i in range(100):
            b.put(f"k{i:03d}", f"v{i}")
        b.delete("k050").put("k051", "again")
        s.write(b)
        assert s.last_seq == 102 and s.get("k050") is None and s.get("k051") == b"again"
        assert len(live(s)) == 99


def test_iterator(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), auto_compact=False) as s:
        for i in range(50):
            s.put(f"k{i:02d}", str(i))
            if i in (20, 40):
                s.flush()
        s.delete("k30")
        keys = [k for k, _ in live(s)]
        assert keys == [f"k{i:02d}".encode() for i in range(50) if i != 30]
        assert [k for k, _ in live(s, start="k10")][:2] == [b"k11", b"k12"]
        assert [k for k, _ in live(s, start="k10", inclusive=True)][0] == b"k10"
        assert [k for k, _ in live(s, reverse=True)] == keys[::-1]
        assert [k for k, _ in live(s, start="k10", reverse=True)][:2] == [b"k09", b"k08"]
        assert [k for k, _ in live(s, limit=3)] == keys[:3]
        assert next(s.items(start="k29"))[0] == b"k31"
        assert [bytes(r.k) for r in s.prefix("k4").collect()] == keys[-10:]


def test_snapshots(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.put("a", "1")
        s.put("b", "1")
        old = s.get_snapshot()
        s.put("a", "2")
        s.delete("b")
        for step in (lambda: None, s.flush, s.compact_range):
            step()
            assert s.get("a", old) == b"1" and s.get("b", old) == b"1" and s.get("b") is None
            assert live(s, snapshot=old) == [(b"a", b"1"), (b"b", b"1")] and live(s) == [(b"a", b"2")]
        assert s.smallest_snapshot == 2 and s.snapshots.oldest == s.snapshots.newest == 2
        s.release_snapshot(old)
        s.put("a", "3")
        s.put("c", "3")
        s.compact_range()
        assert s.log().count() == 2 and live(s) == [(b"a", b"3"), (b"c", b"3")]


def test_recovery(spark, tmp_path):
    path = str(tmp_path / "s")
    for i in range(4):
        with Store.open(spark, path) as s:
            assert all(s.get(f"k{j}") == b"v" for j in range(i))
            s.put(f"k{i}", "v")
    log = next(x for x in (tmp_path / "s").iterdir() if x.suffix == ".log" and x.stat().st_size)
    log.write_bytes(log.read_bytes() + b"\x01\x02\x03torn")
    with Store.open(spark, path) as s:
        assert len(live(s)) == 4 and s.last_seq == 4


def test_lock(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    with pytest.raises(LockFailed, match="Lock fail"):
        Store.open(spark, str(tmp_path / "s"))
    s.close()
    with pytest.raises(StoreError):
        s.put("a", "b")
    Store.open(spark, str(tmp_path / "s")).close()


def test_open_options(spark, tmp_path):
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "s"), create_if_missing=False)
    Store.open(spark, str(tmp_path / "s")).close()
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "s"), error_if_exists=True)


def test_manifest_lets_one_writer_win(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        base = s.version
        s.manifest.commit(base, Edit())
        with pytest.raises(Conflict):
            s.manifest.commit(base, Edit())
        assert s.manifest.read().number == base.number + 1


def test_many_writers_and_levels(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), write_buffer=20_000, checkpoint_every=4) as s:
        r = random.Random(1)
        expected = {}
        for _ in range(1500):
            k = f"{r.randint(0, 300):04d}"
            expected[k] = r.randbytes(20)
            s.put(k, expected[k])
        threads = [threading.Thread(target=lambda i=i: [s.put(f"t{i}-{j}", "x") for j in range(50)]) for i in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert s.last_seq == 1700
        s.compact_range()
        assert dict(live(s)) == {k.encode(): v for k, v in expected.items()} | {f"t{i}-{j}".encode(): b"x" for i in range(4) for j in range(50)}
        assert s.log().count() == len(live(s))
        assert s.compaction_stats().where("runs > 0").count() and s.levels().count() == 1
        assert s.delete_obsolete(0)
    with Store.open(spark, str(tmp_path / "s")) as s:
        assert len(live(s)) == len(expected) + 200


def test_bulk_write(spark, tmp_path):
    ops = spark.range(1000).select(F.lit(1).alias("op"), F.encode(F.format_string("%04d", F.col("id") % 400), "UTF-8").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("v"), "id")
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.put("0000", "old")
        assert s.write_frame(ops, ["id"], batch=("b", 1))
        assert not s.write_frame(ops, ["id"], batch=("b", 1))
        assert s.last_seq == 1001 and s.get("0000") == b"800" and s.get("0399") == b"799" and len(live(s)) == 400
        assert s.get("0000", 1) == b"old"
        asked = spark.createDataFrame([(bytearray(b"0001"),), (bytearray(b"none"),)], "k binary")
        assert {bytes(r.k): r.v and bytes(r.v) for r in s.multi_get(asked).collect()} == {b"0001": b"801", b"none": None}
        s.view("live_keys")
        assert spark.sql("SELECT count(*) n FROM live_keys").first().n == 400


def test_repair(spark, tmp_path):
    path = tmp_path / "s"
    with Store.open(spark, str(path), auto_compact=False) as s:
        for i in range(30):
            s.put(f"k{i % 20:02d}", str(i))
            if i in (9, 19):
                s.flush()
        s.delete("k05")
    import shutil

    shutil.rmtree(path / "_commits")
    (path / "tables" / "bad").mkdir()
    (path / "tables" / "bad" / "part-0.parquet").write_bytes(b"no table")
    (path / "tables" / "bad" / "_made").write_bytes(b"")
    with pytest.raises(StoreError):
        Store.open(spark, str(path))
    repair(spark, str(path))
    with Store.open(spark, str(path)) as s:
        assert s.last_seq == 31
        assert live(s) == [(f"k{i:02d}".encode(), str(i + 20 if i < 10 else i).encode()) for i in range(20) if i != 5]
    assert any("bad" in x.name for x in (path / "lost").iterdir())


def test_stream(spark, tmp_path):
    ops = spark.range(100).select(F.lit(1).alias("op"), F.encode((F.col("id") % 10).cast("string"), "UTF-8").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("v"), "id")
    ops.coalesce(1).write.parquet(str(tmp_path / "in"))
    with Store.open(spark, str(tmp_path / "s")) as s:
        stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
        ingest(s, stream, ["id"], str(tmp_path / "c"), once=True).awaitTermination(60)
        assert dict(live(s)) == {str(i).encode(): str(90 + i).encode() for i in range(10)}
        ingest(s, stream, ["id"], str(tmp_path / "c2"), once=True).awaitTermination(60)
        assert s.last_seq == 100


def test_repair_leaves_dead_rows_dead(spark, tmp_path):
    """A deletion whose table is gone stays in force, and so does the absence of writes that never ended."""
    import shutil

    path = tmp_path / "s"
    with Store.open(spark, str(path), auto_compact=False) as s:
        s.put("k", "old")
        s.put("other", "1")
        s.flush()
        s.delete("k")
        s.flush()
        s.compact_range()
        assert s.get("k") is None
        s.delete_obsolete(0.0)
    left = [x for x in (path / "tables").iterdir()]
    unfinished = path / "tables" / "unfinished"
    shutil.copytree(left[0], unfinished)
    (unfinished / "_made").unlink()
    shutil.rmtree(path / "_commits")
    repair(spark, str(path))
    with Store.open(spark, str(path)) as s:
        assert s.get("k") is None and live(s) == [(b"other", b"1")] and s.log().count() == 1


def test_repair_after_part_of_the_inputs_went(spark, tmp_path):
    import shutil

    path = tmp_path / "s"
    with Store.open(spark, str(path), auto_compact=False) as s:
        s.put("k", "old")
        s.flush()
        kept = {x.name for x in (path / "tables").iterdir()}
        s.delete("k")
        s.flush()
        s.compact_range()
        copy = tmp_path / "copy"
        shutil.copytree(path / "tables", copy)
        s.delete_obsolete(0.0)
    # as if deleting had stopped before the older table went
    for name in kept:
        shutil.copytree(copy / name, path / "tables" / name)
    shutil.rmtree(path / "_commits")
    repair(spark, str(path))
    with Store.open(spark, str(path)) as s:
        assert s.get("k") is None and live(s) == []


def test_repair_drops_malformed_rows(spark, tmp_path):
    import shutil

    from tidemark.model import LOG

    path = tmp_path / "s"
    with Store.open(spark, str(path), auto_compact=False) as s:
        s.put("a", "1")
        s.flush()
    spark.createDataFrame([(bytearray(b"b"), 2, 1, bytearray(b"2")), (bytearray(b"c"), -5, 1, None), (bytearray(b"d"), 3, 9, None)], LOG).coalesce(1).write.parquet(str(path / "tables" / "more"))
    (path / "tables" / "more" / "_made").write_bytes(b"")
    shutil.rmtree(path / "_commits")
    repair(spark, str(path))
    with Store.open(spark, str(path)) as s:
        assert live(s) == [(b"a", b"1"), (b"b", b"2")] and s.log().count() == 2


def test_lock_has_one_owner(spark, tmp_path):
    from tidemark.sources.files import Folder
    from tidemark.sources.lock import Lock

    folder = Folder(spark, str(tmp_path))
    a = Lock(folder, 0.4)
    a.take()
    a._stop.set()  # it stops refreshing, as if it hung
    import time

    time.sleep(0.6)
    b = Lock(folder, 0.4)
    b.take()
    a._stop.clear()
    a._refresh()
    assert a.lost and not b.lost and folder.read("LOCK") == b.owner.encode()
    b.release()


def test_waiting_writers_commit_together(spark, tmp_path):
    from tidemark.operators.batch import leading_group

    assert leading_group([(10, False), (10, False), (10, True), (10, False)]) == 2
    assert leading_group([(10, True), (10, False), (10, True)]) == 3
    assert leading_group([(10, False), (128 << 10, False), (1, False)]) == 2
    assert leading_group([(200 << 10, False)] * 9) == 5
    assert leading_group([(5 << 20, False), (1, False)]) == 1
    with Store.open(spark, str(tmp_path / "s")) as s:
        workers = [threading.Thread(target=lambda i=i: [s.put(f"{i}-{j}", "v") for j in range(50)]) for i in range(8)]
        [w.start() for w in workers]
        [w.join() for w in workers]
        assert s.last_seq == 400 and len(live(s)) == 400 and not s._waiting


def test_outputs_end_where_too_much_lies_below(spark, tmp_path):
    from tidemark.sources import tables
    from tidemark.sources.files import Folder
    from tidemark.model import LOG, Options

    folder = Folder(spark, str(tmp_path))
    rows = spark.createDataFrame([(bytearray(b"%03d" % i), i + 1, 1, bytearray(b"v")) for i in range(300)], LOG)
    made = tables.write(rows, folder, 1, 7, 1, Options(), [b"050", b"199"])
    ends = [(f.smallest_k, f.largest_k) for f in made]
    assert ends == sorted(ends) and sum(f.n_rows for f in made) == 300
    assert {hi for _, hi in ends} >= {b"050", b"199", b"299"} and {lo for lo, _ in ends} >= {b"000", b"051", b"200"}
    assert all(f.max_seq - f.min_seq + 1 == f.n_rows == int(f.largest_k) - int(f.smallest_k) + 1 for f in made)
    assert tables.read(spark, folder, made).count() == 300
    assert [x.__dict__ for x in tables.describe(spark, folder, [f.path for f in made], 1, 7)] == [x.__dict__ for x in made]


def test_feed_brings_new_rows_once(spark, tmp_path):
    from tidemark.streaming.ingest import change_feed

    seen = []
    with Store.open(spark, str(tmp_path / "s"), auto_compact=False) as s:

        def follow():
            change_feed(s, lambda rows, n: seen.append(sorted((bytes(r.k), r.seq) for r in rows.collect())), str(tmp_path / "c"), once=True).awaitTermination(60)

        s.put("a", "1")
        s.flush()
        follow()
        s.put("b", "2")
        s.delete("a")
        s.flush()
        # a table of a write that never committed
        spark.createDataFrame([(bytearray(b"x"), 9, 1, None)], s.log().schema).write.parquet(str(tmp_path / "s" / "tables" / "no"))
        s.compact_range()
        follow()
        follow()
    assert seen == [[(b"a", 1)], [(b"a", 3), (b"b", 2)]]


def test_slow_and_full_level_0(spark, tmp_path):
    import time

    with Store.open(spark, str(tmp_path / "s"), auto_compact=False, l0_trigger=2, l0_slowdown=2, l0_stop=3, max_flush_level=0, write_buffer=40, slowdown_s=0.3) as s:
        for i in range(3):
            s.put("k", "v" * 60)
            s.flush()
        started = time.perf_counter()
        s.put("k", "w" * 60)
        assert time.perf_counter() - started >= 0.3
        s.put("k", "x" * 60)
        assert s._n_level_0() <= 3 and s.get("k") == b"x" * 60


def test_multi_get_opens_few_files(spark, tmp_path):
    from tidemark.functions import keys

    rows = spark.range(1000).select(F.lit(1).alias("op"), keys.long_key("id").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("v"), "id")
    with Store.open(spark, str(tmp_path / "s"), auto_compact=False) as s:
        s.write_frame(rows, ["id"], n_files=8)
        asked = spark.range(10, 13).select(keys.long_key("id").alias("k"))
        found = s.multi_get(asked)
        assert sorted(bytes(r.v) for r in found.collect()) == [b"10", b"11", b"12"]
        assert len([x for x in found.inputFiles()]) == 1
        many = s.multi_get(spark.range(0, 2000, 3).select(keys.long_key("id").alias("k")))
        assert many.count() == 667 and many.where("v IS NOT NULL").count() == 334

"""Removal of long repeated strings with suffix arrays (operator 7).

Every byte goes that lies in a string of SPAN bytes which also starts anywhere else, in the same document or another.

Anchors. The leftmost of the least hashes of the GRAM-byte substrings of any WINDOW bytes depends on those bytes alone.
Equal strings of SPAN bytes start with equal windows, and so have equal anchors at equal places. Hashes that stand at one
anchor of the corpus only are left out; that is decided on the hashes, about one for 50 bytes of text.

Parts. The strings of SPAN bytes with one anchor are parted by how far they start before it, STEP distances at a time. All
strings of a part have a block of bytes in common; equal strings have equal blocks, and the block's hash says to which
shard a part goes. So no repeat is split between shards, however the text is spread, and of a part's text only the few
bytes before and after its block travel. Parts that are equal count once and repeat; parts alone with their block do not.

Hot blocks. Where a block has more than HOT different parts, each is parted in two again, whose blocks are longer, down to
single strings if need be, so that a passage in many contexts is no one's task.

Suffix arrays. What is left of a shard makes a text: bytes, and a symbol for each block that counts as the block's length.
Its suffixes and common prefixes are sorted by external induction (suffixes.py), in bounded memory whatever the shard's
size. Neighbours with SPAN bytes in common repeat.

Beside it, passages are counted that documents share: runs of bytes covered by anchors' GRAM bytes that other documents
have as anchors too. Every WINDOW bytes that two documents share hold such an anchor, so no shared passage of that length
is missed; a run may start and end up to WINDOW - GRAM bytes inside the passage. More than 50 words of prose are about 300
bytes.

Steps end in tables in the shared folder. Texts are shuffled twice, to where their parts and then their spans are.

Defined cases: a null text is empty; what is shorter than SPAN bytes loses nothing, and what is shorter than WINDOW has no
passages. Repeated rows are copies of a text like any other, and are one passage as a whole. Null ids are kept. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffixes
from .common import Written, as_bytes, release

SPAN, WINDOW, GRAM, STEP = 400, 256, 160, 32
BLOCK = 1 << 20
#: Symbols from which a task starts a new shard, at the next block.
SHARD = 1 << 22
#: Parts that a task sorts.
TASK = 1 << 16
#: Different parts of a block from which they are parted again.
HOT = 256
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to 0, 1, ... n - 1, modulo 2 to 64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the bytes at each place and the gram - 1 after it."""
    n = len(data)
    value = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(31)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _power(_R, n), dtype=np.uint64)))
    out = (total[gram:] - total[:-gram]) * _power(_R_INVERSE, n - gram + 1)
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _sliding(op: np.ufunc, a: np.ndarray, width: int, neutral: int) -> np.ndarray:
    """op over each `width` neighbours."""
    rows = np.concatenate((a, np.full(-len(a) % width, neutral, a.dtype))).reshape(-1, width)
    ahead = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: len(a) - width + 1], ahead[width - 1 : len(a)])


def segments(raw: bytes, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a text's windows: the hash, first window, number of windows and anchor of its segments."""
    n_windows, width = len(raw) - window + 1, window - gram + 1
    place = np.uint64((1 << (BLOCK + window).bit_length()) - 1)
    for a in range(0, max(0, n_windows), BLOCK):
        b = min(n_windows, a + BLOCK)
        h = _hashes(np.frombuffer(raw, np.uint8, b - a + window - 1, a), gram)
        least = _sliding(np.minimum, (h & ~place) | np.arange(len(h), dtype=np.uint64), width, (1 << 64) - 1)
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        anchor = (least[starts] & place).astype(np.int64)
        yield h[anchor].view(np.int64), starts + a, np.diff(np.append(starts, b - a)), anchor + a


# --- shards

_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SQL_RANGES = "array<struct<lo:long,hi:long>>"


def _digest(*parts: bytes) -> bytes:
    """128 bits of a row of byte strings."""
    h = hashlib.blake2b(digest_size=16)
    for x in parts:
        h.update(len(x).to_bytes(8, "little") + x)
    return h.digest()


def _ranges(flags: np.ndarray) -> list[dict]:
    """The runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()
    return [{"lo": a, "hi": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


class _Shard:
    """The text of parts in a file, until it is sorted."""

    def __init__(self, span: int):
        self.span, self.file, self.size, self.blocks, self.parts = span, tempfile.TemporaryFile(), 0, [], []

    def add(self, key: tuple, n: int, left: bytes, block: int, right: bytes, new: bool) -> None:
        """A part of n strings, which start in `left` or at the block; new: no part of this block came before."""
        if new:
            self.blocks.append(block)
        symbols = [np.frombuffer(left, np.uint8).astype(np.int32) + 2, [257 + len(self.blocks)], np.frombuffer(right, np.uint8).astype(np.int32) + 2, [1]]
        symbols = np.concatenate(symbols).astype(np.int32)
        self.file.write(symbols.tobytes())
        self.parts.append((key, self.size, n))
        self.size += len(symbols)

    def repeats(self) -> list[tuple[tuple, list[dict]]]:
        """The ranges of repeated strings of each part that has some."""
        self.file.write(np.zeros(1, np.int32).tobytes())
        self.file.seek(0)
        text = np.asarray(np.memmap(self.file, np.int32, "r"))
        starts, found = suffixes.mapped(len(text), "?"), suffixes.mapped(len(text), "?")
        for _, a, n in self.parts:
            starts[a : a + n] = True
        weight = np.concatenate((np.ones(258, np.int32), np.array(self.blocks, np.int32)))
        low, last = self.span, -1
        for _, at, lcp in suffixes.suffixes(text, len(weight), self.span, weight):
            # other suffixes lie in the parts of others too
            k = np.flatnonzero(starts[at])
            if not len(k):
                low = min(low, int(lcp.min()))
                continue
            least = np.minimum.reduceat(lcp[: k[-1] + 1], np.concatenate(([0], k[:-1] + 1)))
            least[0] = min(low, int(least[0]))
            low = int(lcp[k[-1] + 1 :].min(initial=self.span))
            same, own = least >= self.span, at[k]
            found[own[same]] = True
            found[np.concatenate(([last], own[:-1]))[same]] = True
            last = int(own[-1])
        self.file.close()
        marked = ((key, _ranges(found[a : a + n])) for key, a, n in self.parts)
        return [x for x in marked if x[1]]


def _sorted_shards(rows: DataFrame, span: int) -> DataFrame:
    """v, dig, ranges of strings that repeat, for rows (v, dig, n, left, block, right) that lie by v."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("v", pa.binary()), ("dig", pa.binary()), ("ranges", _RANGES)])

        def done(shard: _Shard) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"v": v, "dig": d, "ranges": r} for (v, d), r in shard.repeats()], schema)

        shard, last = _Shard(span), None
        for b in batches:
            for v, d, n, left, block, right in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if v != last and shard.size > SHARD:
                    yield done(shard)
                    shard = _Shard(span)
                shard.add((v, d), n, left, block, right, v != last)
                last = v
        if shard.size:
            yield done(shard)

    return rows.mapInArrow(each, f"v binary, dig binary, ranges {_SQL_RANGES}")


def _halved(parts: DataFrame) -> DataFrame:
    """Parts (v, dig, root_v, root_dig, shift, n, lo, hi, left, block, right, places) in two: the strings that start far
    before the anchor, and those that start near it. lo and hi are their distances, shift the strings before the part in
    its root."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                # the block starts lo before the anchor; the first string starts len(left) before the block
                lo, hi, left, right, n = r["lo"], r["hi"], r["left"], r["right"], r["n"]
                half = (lo + hi) // 2
                cut = min(max(len(left) + lo - half + 1, 0), n)
                ends = hi - 1 - lo - len(left)  # bytes of right in the first string
                for a, to, new_lo, new_hi in ((0, cut, half, hi), (cut, n, lo, half)):
                    if a < to:
                        more_left, more_right = new_lo - lo, hi - new_hi
                        new_left, new_right = left[a : len(left) - more_left], right[more_right : max(more_right, ends + to - 1)]
                        common = left[len(left) - more_left :], right[:more_right]
                        v = _digest(r["v"], b"%d %d" % (new_lo, new_hi), *common)
                        out.append(r | {"v": v, "dig": _digest(b"%d" % (to - a), new_left, new_right), "shift": r["shift"] + a, "n": to - a, "lo": new_lo, "hi": new_hi, "left": new_left, "right": new_right, "block": r["block"] + more_left + more_right})
            yield pa.RecordBatch.from_pylist(out, b.schema)

    return parts.mapInArrow(each, parts.schema)


# --- steps


def _scanned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """row (a number of its own), doc_id, sha, n_bytes, and the hashes of anchors: once each, and those that stand twice."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "sha", "n_bytes", "hashes", "twice"]
        longs = pa.list_(pa.int64())
        for b in batches:
            shas, sizes, hashes, twice = [], [], [], []
            for t in as_bytes(b, "text"):
                t = t or b""
                value, _, _, anchor = map(np.concatenate, zip(*segments(t, window, gram), strict=True)) if len(t) >= window else [np.zeros(0, np.int64)] * 4
                # a block may start with the anchor that the one before ends with
                value, n = np.unique(value[np.unique(anchor, return_index=True)[1]], return_counts=True)
                shas.append(hashlib.sha256(t).digest())
                sizes.append(len(t))
                hashes.append(value)
                twice.append(value[n > 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sizes))), b.column(0), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, longs), pa.array(twice, longs)], names)
            row += len(sizes)

    return docs.select("doc_id", "text").mapInArrow(each, f"row long, doc_id {kind}, sha binary, n_bytes long, hashes array<long>, twice array<long>")


def _runs(text: bytes, anchors: np.ndarray, gram: int) -> list[int]:
    """The whole words of each run of bytes that anchors cover."""
    if not len(anchors):
        return []
    anchors = np.unique(anchors)
    new = np.flatnonzero(np.diff(anchors, prepend=-gram - 1) > gram)
    out = []
    for lo, hi in zip(anchors[new].tolist(), (anchors[np.append(new[1:], len(anchors)) - 1] + gram).tolist(), strict=True):
        torn = lo > 0 and text[lo - 1 : lo].strip() and text[lo : lo + 1].strip(), text[hi - 1 : hi].strip() and text[hi : hi + 1].strip()
        out.append(max(0, len(text[lo:hi].split()) - bool(torn[0]) - bool(torn[1])))
    return out


def _parts(placed: DataFrame, span: int, window: int, gram: int, step: int) -> DataFrame:
    """row, v, dig, n, lo, hi, left, block, right, starts: the different parts of texts (text, row, hashes, others) with one
    of the hashes, and where they start. Where v is null, starts are the words of the runs that `others` have too."""
    fields = [("row", pa.int64()), ("v", pa.binary()), ("dig", pa.binary()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("left", pa.binary()), ("block", pa.int64()), ("right", pa.binary()), ("starts", pa.list_(pa.int64()))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for i, t in enumerate(as_bytes(b, "text")):
                row, wanted, others = b.column(1)[i].as_py(), *(np.array(b.column(c)[i].as_py() or [], np.int64) for c in (2, 3))
                found: dict[tuple, list[int]] = {}
                runs = []
                for value, start, n, anchor in segments(t, window, gram):
                    runs.append(anchor[np.isin(value, others)])
                    at = np.flatnonzero(np.isin(value, wanted))
                    for s, k, a in zip(start[at].tolist(), n[at].tolist(), anchor[at].tolist(), strict=True):
                        end = min(s + k, len(t) - span + 1)
                        while s < end:
                            lo = (a - s) // step * step
                            hi, to = lo + step, min(end, a - lo + 1)
                            # what all strings have in common that start lo to hi - 1 before the anchor
                            at_block, behind = a - lo, a - hi + 1 + span
                            block, left, right = t[at_block:behind], t[s:at_block], t[behind : max(behind, to - 1 + span)]
                            v = xxhash.xxh3_128_digest(block, lo)
                            key = v, _digest(b"%d" % (to - s), left, right), to - s, lo, hi, left, len(block), right
                            found.setdefault(key, []).append(s)
                            s = to
                if words := _runs(t, np.concatenate(runs) if runs else np.zeros(0, np.int64), gram):
                    out.append((row, None, None, None, None, None, None, None, None, words))
                for key, starts in found.items():
                    out.append((row, *key, starts))
                    size += 150 + 8 * len(starts)
                    if size > BLOCK:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()

    kinds = {pa.int64(): "long", pa.binary(): "binary"}
    return placed.select("text", "row", "hashes", "others").mapInArrow(each, ", ".join(f"{n} {kinds.get(t, 'array<long>')}" for n, t in fields))


def _cut(found: DataFrame, span: int, window: int, kind: str) -> DataFrame:
    """The result, from doc_id, text, whole (it has a copy), ranges of repeated strings and words of shared runs."""

    def one(text: bytes, whole: bool | None, ranges: list[dict] | None, words: list[int] | None) -> tuple:
        if whole:
            spans = [[0, len(text)]] if len(text) >= span else []
            words = [len(text.split())] if len(text) >= window else []
        else:
            spans = []
            for lo, hi in sorted((r["lo"], r["hi"] + span - 1) for r in ranges or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        kept, at = hashlib.sha256(), 0
        for lo, hi in spans:
            kept.update(text[at:lo])
            at = hi
        kept.update(text[at:])
        removed = [{"lo": lo, "hi": hi} for lo, hi in spans]
        return len(text), sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest(), len(words or ()), max(words or (), default=0), removed

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _RANGES]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_words", "removed"]
        for b in batches:
            rows = [one(t or b"", *x) for t, *x in zip(as_bytes(b, "text"), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return found.select("doc_id", "text", "whole", "ranges", "words").mapInArrow(each, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, removed {_SQL_RANGES}")


def _unsure(parts: DataFrame) -> DataFrame:
    """v, k (different parts) and far of the blocks of which different parts came, not all of them twice."""
    return parts.groupBy("v").agg(F.count(F.lit(1)).alias("k"), F.min("places").alias("least"), F.max(F.col("hi") - F.col("lo")).alias("far")).where("k > 1 AND least = 1").select("v", "k", "far")


def remove_repeats(docs: DataFrame, span: int = SPAN, window: int = WINDOW, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """For every document doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges; and n_passages and
    passage_words, the runs that other documents share and the whole words of the longest."""
    if not (gram <= window <= span and step < span):
        raise ValueError("gram <= window <= span and step < span are needed")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    scanned = Written(_scanned(docs, window, gram), "scanned")
    texts = Written(scanned.df.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "doc_id")).alias("first"), F.first("n_bytes").alias("n_bytes")).select("sha", "copies", "first.row", F.col("first.doc_id").alias("first_id"), "n_bytes"), "texts")
    # hashes at two anchors at least: of different texts (other), or twice in one
    places = scanned.df.select("row", F.substring("sha", 1, 8).alias("s"), F.explode("hashes").alias("v"))
    places = places.select("row", F.conv(F.hex("s"), 16, -10).cast("long").alias("s"), "v")
    shared = places.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a != b").select("v", F.lit(True).alias("other"))
    twice = scanned.df.select(F.explode("twice").alias("v"), F.lit(False).alias("other"))
    shared = Written(shared.unionByName(twice).groupBy("v").agg(F.max("other").alias("other")), "shared")
    by_row = places.select("row", "v").join(shared.df, "v").groupBy("row").agg(F.collect_list("v").alias("hashes"), F.collect_list(F.when(F.col("other"), F.col("v"))).alias("others"))
    wanted = Written(by_row.join(texts.df, "row").select("sha", "row", "first_id", "hashes", "others"), "wanted")
    scanned.drop()
    shared.drop()
    release(spark)

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("sha", F.unhex(F.sha2("text", 256)))
    placed = own.join(wanted.df, (own["sha"] == wanted.df["sha"]) & own["doc_id"].eqNullSafe(wanted.df["first_id"]))
    pieces = Written(_parts(placed, span, window, gram, step), "pieces")
    wanted.drop()
    release(spark)

    # equal parts count once; those at two places repeat
    first = [F.first(c).alias(c) for c in ("n", "lo", "hi", "left", "block", "right")]
    kinds = Written(pieces.df.where("v IS NOT NULL").groupBy("v", "dig").agg(*first, F.sum(F.size("starts")).alias("places")), "kinds")
    parts = kinds.df.select("v", "dig", F.col("v").alias("root_v"), F.col("dig").alias("root_dig"), F.lit(0).cast("long").alias("shift"), "n", "lo", "hi", "left", "block", "right", "places")
    unsure = Written(_unsure(parts), "unsure")
    tables, known = [kinds, unsure], []
    columns = ["root_v", "root_dig", "shift", "n"]
    known.append(parts.where("places > 1").select(*columns))
    halves = []
    parts = parts.join(unsure.df, "v")
    while True:
        # as parts get smaller, those of a hot block turn out to be equal or alone
        settled, hot = parts.where(f"k <= {HOT} OR far <= 1").drop("k", "far"), parts.where(f"k > {HOT} AND far > 1").drop("k", "far")
        halves.append(settled)
        if hot.isEmpty():
            break
        made = Written(_halved(hot), "halves")
        sums = made.df.groupBy("v", "dig").agg(F.sum("places").alias("all"))
        again = Written(made.df.join(sums, ["v", "dig"]).withColumn("places", F.col("all")).drop("all"), "again")
        made.drop()
        unsure = Written(_unsure(again.df.dropDuplicates(["v", "dig"])), "unsure")
        tables += [again, unsure]
        known.append(again.df.where("places > 1").select(*columns))
        parts = again.df.join(unsure.df, "v")
    open_ = halves[0]
    for x in halves[1:]:
        open_ = open_.unionByName(x)
    rows = Written(open_.groupBy("v", "dig").agg(*(F.first(c).alias(c) for c in ("n", "left", "block", "right"))), "open")
    tables.append(rows)
    # sorting has a cost for each row of a queue that grows slower than the shard: tasks get as much as they bear
    dealt = rows.df.repartition(max(1, -(-rows.df.count() // TASK)), "v").sortWithinPartitions("v")
    marked = Written(_sorted_shards(dealt.select("v", "dig", "n", "left", "block", "right"), span), "marked")
    release(spark)

    # what was found of parts goes to their roots, and from these to all their places
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    found = open_.select("v", "dig", *columns).join(marked.df, ["v", "dig"]).select(*columns, "ranges")
    for x in known:
        found = found.unionByName(x.withColumn("ranges", whole))
    found = found.select(F.col("root_v").alias("v"), F.col("root_dig").alias("dig"), F.expr("transform(ranges, r -> struct(r.lo + shift AS lo, r.hi + shift AS hi))").alias("ranges"))
    windows = pieces.df.select("row", "starts", "v", "dig").join(found, ["v", "dig"])
    windows = windows.select("row", F.expr("flatten(transform(starts, s -> transform(ranges, r -> struct(r.lo + s AS lo, r.hi + s AS hi))))").alias("ranges"), F.lit(None).cast("array<long>").alias("words"))
    windows = windows.unionByName(pieces.df.where("v IS NULL").select("row", F.lit(None).cast(_SQL_RANGES).alias("ranges"), F.col("starts").alias("words")))
    by_row = windows.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("words")).alias("words"))
    spans = texts.df.join(by_row, "row", "left").select("sha", (F.col("copies") > 1).alias("whole"), *(F.when(F.col("copies") == 1, F.col(c)).alias(c) for c in ("ranges", "words")))
    spans = Written(spans.where("whole OR ranges IS NOT NULL OR words IS NOT NULL"), "spans")
    for t in (pieces, texts, marked, *tables):
        t.drop()
    release(spark)
    return _cut(own.join(spans.df, "sha", "left"), span, window, kind)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats over all documents; the removed ranges stay behind."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")

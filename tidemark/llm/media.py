"""Copies of images by local descriptors (operator 2): cropped, scaled, turned and re-toned ones are found.

Describing. Corners (the smaller eigenvalue of the structure tensor) are taken on a pyramid of SCALES, the strongest of an
image, one for PER_KEYPOINT pixels; of queries, which are few, more on a finer pyramid. Each gets the direction of its patch's intensity centroid, and 128 tests of which of
two places is brighter, on a pattern turned by that direction. The smoothed image is read; a change of tone leaves the
tests as they are.

Joining. TABLES keys of KEY_BITS of the 128 bits each; a query has further keys, in each of which one of its UNSURE tests is
turned over, so that keys can be long, and strangers few, without losing copies. Every image that a query shares MIN_HITS
buckets with is its candidate. The query set is stated (a fiftieth of all rows), so the keys of queries, which are few, are
joined with those of all images, one table after the other, so that a fourth of the keys are on disk at once; they move
packed, in buckets that a task meets in memory. No bucket is cut, and no image stands for others: a key that many have makes
all its pairs, block by block. A patch that many images have costs the number of queries that have it times theirs.

Deciding. For each candidate all descriptors within MAX_DISTANCE bits are matched, and pairs of matches propose a turn,
scale and shift; MIN_INLIERS matches, SPOT pixels apart, within TOLERANCE pixels of one proposal make a link. All pairs of
up to PARTNERS matches propose, of more each with the PARTNERS after it. All proposals are bounded in single precision, and
those that may bring most are counted exactly. Classes are dealt to slices, and a query goes to those where it meets any, so
that a class moves once, however many queries it meets.

Identical images form a class, described and joined once, however many rows it has; links are between queries and classes.
Ids of classes come from the pixels' digest, so that they are the same in every run.

The tables hold no images: op2 draws each page's whole text (`pictures`), and asks for an edited copy (`edited`) of every
page whose id is divisible by 50. `described` takes any images.

Defined cases: a null html is empty, and an image without corners links to nothing. Repeated rows are one class. A null id
is no query; equal ids with different html are queries each. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, as_bytes, discard, release

LEAST_SIDE = 64
SCALES, PER_KEYPOINT = (1.0, 0.75), 480
#: Queries are few, and are described more closely.
ASKED_SCALES, ASKED_PER_KEYPOINT = (4 / 3, 1.0, 0.75), 160
LEAST_KEYPOINTS = 20
RADIUS, MARGIN, ANGLES = 12, 13, 32
TABLES, KEY_BITS = 4, 56
#: Tests of a query that are closest to call and may have come out otherwise in a copy.
UNSURE = 16
MAX_DISTANCE = 30
MIN_HITS = 2
MIN_INLIERS, TOLERANCE, SPOT = 6, 1.5, 6.0
PARTNERS = 48
EVERY = 50
#: Pixels that are described at once: few enough for a core's cache, the keypoints are the same for any number.
STACK = 1 << 15
#: So many places are compared with proposed ones at once, for the same reason.
PROPOSED = 1 << 15
#: Classes are made and links confirmed in so many parts one after the other, so that little is shuffled at once.
PARTS = 4
#: Keys are dealt to buckets of so many, at least so many buckets, from so many keypoints at once; pairs that meet are made so
#: many at once.
BUCKET, LEAST_BUCKETS, DEALT, MEETING = 1 << 20, 16, 1 << 16, 1 << 18
#: Of a part, so many pairs are confirmed and so many classes held by a task.
SLICE, LEAST_SLICES = 4096, 12
#: A keypoint: its place in half pixels, the results of its tests, and of queries which of these are unsure.
_RECORD = np.dtype([("x", "<u4"), ("y", "<u4"), ("d", "<u8", 2), ("unsure", "<u8", 2)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (np.atleast_1d(np.asarray(x) if not isinstance(x, int) else np.uint64(x % (1 << 64))).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pattern() -> np.ndarray:
    """Places of the tests, (ANGLES, 128, 2 places, y and x): a fixed pseudo-random choice in a disc, turned."""
    n = _mix(np.arange(128 * 4).reshape(128, 2, 2)).astype(np.float64) / 2.0**64
    r, a = RADIUS * np.sqrt(n[..., 0]), 2 * np.pi * n[..., 1]
    turned = a[None] + 2 * np.pi * np.arange(ANGLES)[:, None, None] / ANGLES
    return np.rint(np.stack([r * np.sin(turned), r * np.cos(turned)], -1)).astype(np.int32)


_TESTS = _pattern()
_BITS = np.argsort(_mix(np.arange(TABLES * 128).reshape(TABLES, 128)), axis=1)[:, :KEY_BITS]


# --- pictures


def pictures(pages: list[bytes]) -> list[np.ndarray]:
    """A square picture of the whole text of each page: a cell of 2 by 2 pixels for each character, in a grey that it and
    those around it give; white at the end."""
    out = []
    for html in pages:
        body = html[html.find(b"<article") :] if b"<article" in html else html
        text = " ".join(re.sub(r"<(script|style).*?</\1>|<[^>]*>", " ", body.decode("utf-8", "replace"), flags=re.S).split())
        line = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        # sides in steps, so that pictures of one size are many
        side = max(LEAST_SIDE // 2, -(-int(np.ceil(np.sqrt(len(line)))) // 4) * 4)
        cells = np.zeros(side * side, np.uint64)
        cells[: len(line)] = line
        near = np.pad(cells, (0, 1))
        grey = (20 + (_mix(_mix(near[:-1]) ^ near[1:]) >> np.uint64(56)) % np.uint64(200)).astype(np.float32)
        grey[len(line) :] = 235
        out.append(grey.reshape(side, side).repeat(2, 0).repeat(2, 1))
    return out


def resized(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, of the last two axes."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(np.int64), n - 2)
        return lo, lo + 1, (at - lo).astype(np.float32)

    a, b, f = axis(images.shape[-2], h)
    rows = images[..., a, :] * (1 - f)[:, None] + images[..., b, :] * f[:, None]
    a, b, f = axis(images.shape[-1], w)
    return rows[..., a] * (1 - f) + rows[..., b] * f


EDITS = ("cut", "enlarged", "turned", "shrunk")


def edited(image: np.ndarray, seed: int) -> np.ndarray:
    """A part of the image (at least four fifths of either side), in another tone and grain, and by the seed also larger,
    turned or smaller."""
    r = _mix(np.arange(6, dtype=np.uint64) + _mix(seed)) >> np.uint64(8)
    h, w = (int(n) - int(r[i]) % (int(n) // 5 + 1) for i, n in enumerate(image.shape))
    y, x = int(r[2]) % (image.shape[0] - h + 1), int(r[3]) % (image.shape[1] - w + 1)
    part, kind = image[y : y + h, x : x + w], kind_of(seed)
    if kind in ("enlarged", "shrunk"):
        factor = 4 / 3 if kind == "enlarged" else 3 / 4
        part = resized(part, round(factor * h), round(factor * w))
    if kind == "turned":
        part = np.rot90(part)
    grain = _mix(np.arange(part.size, dtype=np.uint64) + np.uint64(seed % (1 << 63))).reshape(part.shape) >> np.uint64(61)
    return np.clip(part * 0.8 + 25 + grain, 0, 255).astype(np.float32)


def kind_of(seed: int) -> str:
    return EDITS[int(_mix(_mix(seed))[0] >> np.uint64(60)) % len(EDITS)]


# --- descriptors


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, where they lie inside; the rest is 0. Lines are added from one image's end to the
    next one's start, which is faster than one by one."""
    _, h, w = a.shape
    flat, out = a.reshape(-1), np.zeros(a.size, a.dtype)
    n = max(0, a.size - 2 * r * w)
    rows = flat[:n].copy()
    for i in range(1, 2 * r + 1):
        rows += flat[i * w : i * w + n]
    n = max(0, n - 2 * r)
    inner = out[r * w + r : r * w + r + n]
    inner += rows[:n]
    for i in range(1, 2 * r + 1):
        inner += rows[i : i + n]
    out = out.reshape(a.shape)
    out[:, :r], out[:, h - r :], out[:, :, :r], out[:, :, w - r :] = 0, 0, 0, 0
    return out


def describe(images: np.ndarray, asked: bool = False) -> list[np.ndarray]:
    """The keypoints of each of a stack of images of one size, of queries or not: x, y and descriptor."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    height, width = images.shape[1:]
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.stack([yy, xx])[:, yy**2 + xx**2 <= RADIUS**2]
    per_keypoint = ASKED_PER_KEYPOINT if asked else PER_KEYPOINT
    for scale in ASKED_SCALES if asked else SCALES:
        h, w = round(height * scale), round(width * scale)
        if min(h, w) <= 2 * MARGIN + 1:
            continue
        level = images if scale == 1 else resized(images, h, w)
        smooth = _box(_box(np.ascontiguousarray(level, np.float32), 2), 1) / np.float32(225)
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        gx[:, :, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2]
        xx_, yy_, xy = (_box(p, 2) for p in (gx * gx, gy * gy, gx * gy))
        corner = (xx_ + yy_) / 2 - np.sqrt(((xx_ - yy_) / 2) ** 2 + xy**2)
        inner = corner[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > 1
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    around = corner[:, MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
                    peak &= inner > around if (dy, dx) > (0, 0) else inner >= around
        flat = np.where(peak, inner, 0).reshape(len(images), -1)
        k = min(max(LEAST_KEYPOINTS, h * w // per_keypoint), flat.shape[1])
        best = np.argpartition(-flat, k - 1, axis=1)[:, :k]
        strong = np.take_along_axis(flat, best, 1) > 0
        of = np.nonzero(strong)[0]
        y, x = np.divmod(best[strong], w - 2 * MARGIN)
        y, x = y + MARGIN, x + MARGIN
        if not len(of):
            continue
        # places as numbers in the flat stack
        pixels, at = smooth.ravel(), (of * h + y) * w + x
        patch = pixels.take(at[:, None] + (disc[0] * w + disc[1]))
        angle = np.arctan2(patch @ disc[0].astype(np.float32), patch @ disc[1].astype(np.float32))
        turn = np.rint(angle * ANGLES / (2 * np.pi)).astype(np.int64) % ANGLES
        value = pixels.take(at[:, None, None] + (_TESTS[..., 0] * w + _TESTS[..., 1])[turn])
        out = np.empty(len(of), _RECORD)
        out["x"], out["y"] = np.rint((2 * x + 1) / scale), np.rint((2 * y + 1) / scale)
        out["d"] = np.packbits(value[..., 0] < value[..., 1], axis=1, bitorder="little").view("<u8")
        out["unsure"] = 0
        if asked:
            margin = np.abs(value[..., 0] - value[..., 1])
            weak = margin <= np.partition(margin, UNSURE - 1, axis=1)[:, UNSURE - 1 : UNSURE]
            out["unsure"] = np.packbits(weak, axis=1, bitorder="little").view("<u8")
        for i, part in enumerate(np.split(out, np.searchsorted(of, np.arange(1, len(images))))):
            found[i].append(part)
    return [np.concatenate(x) if x else np.empty(0, _RECORD) for x in found]


def _bits_of(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")


def _values(points: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """What the bits of a table say of points, and with one unsure result turned over, and whose it is."""
    bits = np.zeros((len(points), 64), np.uint8)
    bits[:, :KEY_BITS] = _bits_of(points["d"])[:, _BITS[table]]
    own = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    i = k = np.zeros(0, np.int64)
    if points["unsure"].any():
        i, k = np.nonzero(_bits_of(points["unsure"])[:, _BITS[table]])
    return np.concatenate((own, own[i] ^ (np.uint64(1) << k.astype(np.uint64)))), np.concatenate((np.arange(len(points)), i))


def keys_of(points: np.ndarray, tables: range = range(TABLES)) -> np.ndarray:
    """The keys of points, once each: of each table that of the results, and those with one unsure result turned over."""
    keys = [_mix(_mix(_values(points, t)[0]) ^ np.uint64(t)) for t in tables]
    return np.unique(np.concatenate(keys).view(np.int64)) if len(points) else np.zeros(0, np.int64)


def _at_most(factor: np.ndarray, shift: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How many matches each similarity brings to their places, or a few more: in single precision, with its error to spare.
    A few matches' blocks stay in a core's cache."""
    spare = TOLERANCE + 6e-6 * (np.abs(q).max() + np.abs(c).max())
    one, out = np.ones(len(q)), np.zeros(len(factor), np.int64)
    x, y = (np.stack([q.real, q.imag, one, z], 1).astype(np.float32) for z in (c.real, c.imag))
    u, v = (np.stack([*z, -np.ones(len(factor))]).astype(np.float32) for z in ((factor.real, -factor.imag, shift.real), (factor.imag, factor.real, shift.imag)))
    step, limit = max(64, PROPOSED // min(len(q), 255)), np.float32(spare**2)
    for a in range(0, len(factor), step):
        for b in range(0, len(q), 255):
            re, im = x[b : b + 255] @ u[:, a : a + step], y[b : b + 255] @ v[:, a : a + step]
            re *= re
            im *= im
            re += im
            # 255 rows at most: a byte counts them
            out[a : a + step] += np.add.reduce((re <= limit).view(np.uint8), axis=0, dtype=np.uint8)
    return out


def _spots(places: np.ndarray) -> int:
    return len(set(np.round(places / SPOT).tolist()))


def _partners(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a few matches each pair once, of many each with those after it, in a ring."""
    if n <= PARTNERS:
        return _pairs(n)
    i, j = np.repeat(np.arange(n), PARTNERS), (np.arange(n)[:, None] + np.arange(1, PARTNERS + 1)).ravel()
    return i, j % n


@functools.cache
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def consensus(query: np.ndarray, other: np.ndarray) -> tuple[int, complex, complex]:
    """The most matches that one similarity (factor, shift) brings to their places, and that similarity; 0 if fewer than
    MIN_INLIERS."""
    if min(len(query), len(other)) < MIN_INLIERS:
        return 0, 0j, 0j
    # word by word: two bytes' sum is faster than one along a short axis
    low, high = (np.bitwise_count(query["d"][:, k].copy()[:, None] ^ other["d"][:, k].copy()) for k in range(2))
    low += high
    best = low.argmin(1)
    which = np.flatnonzero(low[np.arange(len(query)), best] <= MAX_DISTANCE)
    if len(which) < MIN_INLIERS:
        return 0, 0j, 0j
    best = best[which]
    q = query["x"][which] / 2 + 1j * query["y"][which] / 2
    c = other["x"][best] / 2 + 1j * other["y"][best] / 2
    if _spots(c) < MIN_INLIERS:
        return 0, 0j, 0j
    i, j = _partners(len(q))
    apart = q[j] - q[i]
    factor = np.zeros(len(apart), np.complex128)
    np.divide(c[j] - c[i], apart, out=factor, where=np.abs(apart) > 4 * TOLERANCE)
    # only fair proposals can win
    size = factor.real**2 + factor.imag**2
    fair = np.flatnonzero((size > 0.4**2) & (size < 2.5**2))
    factor, i = factor[fair], i[fair]
    shift = c[i] - factor * q[i]
    at_most = _at_most(factor, shift, q, c)
    most, top, near = MIN_INLIERS - 1, -1, np.zeros(len(q), np.bool_)
    # from the proposals that may bring most, until the rest can't bring as many
    while len(at_most) and (bound := at_most.max()) >= most + (top < 0):
        some = np.flatnonzero(at_most == bound)
        at_most[some] = -1
        for some in np.split(some, range(64, len(some), 64)):
            off = factor[some, None] * q + shift[some, None] - c
            close = off.real**2 + off.imag**2 <= TOLERANCE**2
            n = np.count_nonzero(close, axis=1)
            a = int(n.argmax())
            # of as many, the first proposal
            if n[a] > most or n[a] == most and some[a] < top:
                most, top, near = int(n[a]), int(some[a]), close[a]
    if top < 0:
        return 0, 0j, 0j
    # matches in one spot, such as a word that two pages share, count once
    return _spots(c[near]), complex(factor[top]), complex(shift[top])


# --- on tables


def _digest(image: np.ndarray) -> int:
    """A class's id: of the pixels and the shape."""
    return int.from_bytes(hashlib.blake2b(repr(image.shape).encode() + image.astype(np.uint8).tobytes(), digest_size=8).digest(), "little", signed=True)


def _rows(ids: list, images: list[np.ndarray], asked: list[bool]) -> pa.RecordBatch:
    """id, query, cid and points; images of one size are described together."""
    points: list[bytes] = [b""] * len(images)
    by_size: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        by_size.setdefault((*x.shape, asked[i]), []).append(i)
    for (h, w, closely), some in by_size.items():
        step = max(1, STACK // (h * w))
        for a in range(0, len(some), step):
            for i, p in zip(some[a : a + step], describe(np.stack([images[i] for i in some[a : a + step]]), closely), strict=True):
                points[i] = p.tobytes()
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(asked, pa.bool_()), pa.array([_digest(x) for x in images], pa.int64()), pa.array(points, pa.binary())], ["id", "query", "cid", "points"])


def described(rows: DataFrame, columns: list[str], draw: Callable[[dict], tuple[list, list[np.ndarray], list[bool]]], block: int = 512) -> DataFrame:
    """id, query, cid (of the picture) and points of the images that draw makes of rows' columns, as ids, grey images
    (height, width) of values up to 255, and which of them are asked for. With `grey_images` the columns hold images."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                yield _rows(*draw({c: as_bytes(part, c) if pa.types.is_string(part.schema.field(c).type) else part.column(c).to_pylist() for c in columns}))

    return rows.select(*columns).mapInArrow(each, "id long, query boolean, cid long, points binary")


def grey_images(part: dict) -> tuple[list, list[np.ndarray], list[bool]]:
    """Images of a media column: id, query, height, width and pixels (a byte each, by rows). A null image has no corners."""
    shapes = [(h or 1, w or 1) if p is not None else (1, 1) for h, w, p in zip(part["height"], part["width"], part["pixels"], strict=True)]
    return part["id"], [np.frombuffer(p or b"\0", np.uint8).astype(np.float32).reshape(s) for p, s in zip(part["pixels"], shapes, strict=True)], [bool(q) for q in part["query"]]


def drawn_pages(part: dict) -> tuple[list, list[np.ndarray], list[bool]]:
    """The picture of each page, and an edited copy as a query of each whose id is divisible by EVERY."""
    ids, images = part["page_id"], pictures([t or b"" for t in part["html"]])
    asked = [i for i, p in enumerate(ids) if p is not None and p % EVERY == 0]
    return ids + [ids[i] for i in asked], images + [edited(images[i], ids[i]) for i in asked], [False] * len(ids) + [True] * len(asked)


_PACKED = -(-KEY_BITS // 8)


def _settle(spark: SparkSession) -> None:
    """Twice: after one collection the last step's shuffle files were seen to stay until the next step had made its own."""
    release(spark)
    release(spark)


def _dealt(rows: DataFrame, table: int, n: int) -> DataFrame:
    """The keys in a table of rows (cid, query, points), dealt to n buckets: bucket, query, cids, how many keys each has there,
    and the keys, without the leading bytes that are zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, asked, blobs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            size = np.array([len(x) for x in blobs], np.int64) // _RECORD.itemsize
            # rows of one kind, up to DEALT keypoints of them together
            new = np.flatnonzero(np.diff(asked) | (np.diff(np.cumsum(size) // DEALT) > 0)) + 1
            for rows_ in np.split(np.arange(len(cids)), new):
                if not size[rows_].any():
                    continue
                found = []
                for some in np.split(rows_, range(256, len(rows_), 256)):
                    keys, whose = _values(np.frombuffer(b"".join([blobs[i] for i in some]), _RECORD), table)
                    found.append((keys, np.repeat(some, size[some])[whose]))
                keys, of = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket = (_mix(keys) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int64)
                # numbers of two bytes are sorted by their digits
                order = np.argsort(of.astype(np.uint16) if len(cids) <= 1 << 16 else of, kind="stable")
                order = order[np.argsort(bucket[order], kind="stable")]
                keys, of, bucket = keys[order], of[order], bucket[order].astype(np.int64)
                # runs of one row in one bucket
                start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])])
                length = np.diff(np.r_[start, len(keys)]).astype("<u4")
                packed = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PACKED]
                runs = np.flatnonzero(np.r_[True, np.diff(bucket[start]) > 0, True])
                ends = np.r_[start, len(keys)][runs]
                out = [[], [], []]
                for k in range(len(runs) - 1):
                    some = slice(runs[k], runs[k + 1])
                    for x, y in zip(out, (cids[of[start[some]]], length[some], packed[ends[k] : ends[k + 1]]), strict=True):
                        x.append(y.tobytes())
                where = bucket[start[runs[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(np.full(len(where), asked[rows_[0]])), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "query", "cids", "lengths", "keys"])

    return rows.select("cid", "query", "points").mapInArrow(each, "bucket int, query boolean, cids binary, lengths binary, keys binary")


def _undealt(cids: bytes, lengths: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cid of each key, and the keys, of a row of _dealt."""
    of = np.repeat(np.frombuffer(cids, np.int64), np.frombuffer(lengths, "<u4"))
    whole = np.zeros((len(of), 8), np.uint8)
    whole[:, :_PACKED] = np.frombuffer(keys, np.uint8).reshape(-1, _PACKED)
    return of, whole.view("<u8")[:, 0]


def _once(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By keys, each once a cid."""
    order = np.lexsort((of, keys))
    of, keys = of[order], keys[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])][: len(of)]
    return of[new], keys[new]


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """q, cid and how many keys they share in a bucket, of rows of _dealt by bucket, those of queries first. A key that many
    have makes all its pairs, MEETING at a time."""
    bucket, parts, asked = -1, [], None
    for b in batches:
        for at, query, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if at != bucket:
                bucket, parts, asked = at, [], None
            if query:
                parts.append(_undealt(*row))
                continue
            if not parts:
                continue
            if asked is None:
                asked = _once(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            of, keys = _undealt(*row)
            low = np.searchsorted(asked[1], keys)
            met = asked[1][np.minimum(low, len(asked[1]) - 1)] == keys
            of, keys = _once(of[met], keys[met])
            low = np.searchsorted(asked[1], keys)
            n = np.searchsorted(asked[1], keys, "right") - low
            for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // MEETING)) + 1):
                if not len(some):
                    continue
                last = np.cumsum(n[some])
                q = asked[0][np.arange(last[-1]) + np.repeat(low[some] - last + n[some], n[some])]
                c = np.repeat(of[some], n[some])
                order = np.lexsort((c, q))
                q, c = q[order], c[order]
                start = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(q[start]), pa.array(c[start]), pa.array(np.diff(np.r_[start, len(q)]))], ["q", "cid", "count"])


def candidates(queries: DataFrame, classes: DataFrame) -> Written:
    """(q, cid): queries and classes (cid, query, points) that share MIN_HITS keys. One table of keys is shuffled after the
    other, packed and in buckets of about BUCKET keys, and of each only stays how many keys a pair shares."""
    spark, hits = classes.sparkSession, []
    size = [x.agg(F.sum(F.octet_length("points"))).first()[0] or 0 for x in (queries, classes)]
    # a query's keypoint has a key and one for each of its unsure results in the table
    n = max(LEAST_BUCKETS, ((1 + UNSURE * KEY_BITS // 128) * size[0] + size[1]) // _RECORD.itemsize // BUCKET)
    for table in range(TABLES):
        dealt = _dealt(queries, table, n).unionByName(_dealt(classes, table, n)).repartition("bucket")
        met = dealt.sortWithinPartitions("bucket", F.desc("query")).mapInArrow(_meeting, "q long, cid long, count long")
        hits.append(Written(met, "hits"))
        del dealt, met
        _settle(spark)
    met = _all(hits).groupBy("q", "cid").agg(F.sum("count").alias("count"))
    pairs = Written(met.where(F.col("count") >= MIN_HITS).select("q", "cid"), "pairs")
    for x in hits:
        x.drop()
    _settle(spark)
    return pairs


def _without_unsure(rows: DataFrame) -> DataFrame:
    """cid and points, whose unsure results are none: these serve keys only, and need not move."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [np.frombuffer(x, _RECORD).copy() for x in b.column(1).to_pylist()]
            for p in points:
                p["unsure"] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in points], pa.binary())], ["cid", "points"])

    return rows.select("cid", "points").mapInArrow(each, "cid long, points binary")


def _confirming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of rows (slice, cids, id, points) by slice, its classes (cids null) first, then its queries: the points of a
    slice's classes are held, a query's cids are those it meets there."""
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4
    now, held = -1, {}
    for b in batches:
        rows = []
        for at, cids, own, points in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if at != now:
                now, held = at, {}
            if cids is None:
                held[own] = points
                continue
            query = np.frombuffer(points, _RECORD)
            for cid in cids:
                n, factor, shift = consensus(query, np.frombuffer(held[cid], _RECORD))
                if n >= MIN_INLIERS:
                    rows.append((own, cid, n, abs(factor), float(np.degrees(np.angle(factor))), shift.real, shift.imag))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["q", "cid", "inliers", "scale", "turn", "dx", "dy"])


def confirmed(pairs: DataFrame, queries: DataFrame, classes: DataFrame, slices: int) -> DataFrame:
    """q, cid, inliers, scale, turn (degrees), dx, dy of the pairs that geometric consensus confirms. Classes are dealt to
    slices, each once; a query goes once to each slice where it meets any."""
    cut = F.pmod(F.xxhash64("cid"), F.lit(slices)).cast("int").alias("slice")
    met = pairs.select("q", "cid", cut).groupBy("slice", "q").agg(F.collect_list("cid").alias("cids"))
    asked = met.join(queries.withColumnRenamed("cid", "q"), "q").select("slice", "cids", F.col("q").alias("id"), "points")
    held = classes.select(cut, F.lit(None).cast("array<long>").alias("cids"), F.col("cid").alias("id"), "points")
    rows = held.unionByName(asked).repartition(slices, "slice").sortWithinPartitions("slice", F.col("cids").isNotNull())
    return rows.mapInArrow(_confirming, "q long, cid long, inliers long, scale double, turn double, dx double, dy double")


def _all(parts: list[Written]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [x.df for x in parts])


def find_copies(images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, query, cid), classes (cid, query, points) and links (q, cid, inliers, scale, turn, dx, dy) from the class of
    a query to that of an image, for described images."""
    spark = images.sparkSession
    part = F.pmod("cid", F.lit(PARTS)).cast("int")
    every = Written(images.withColumn("part", part), "described", "part")
    rows = Written(every.df.select("id", "query", "cid"), "rows")
    classes = []
    for i in range(PARTS):
        own = every.df.where(F.col("part") == i).groupBy("cid", "query").agg(F.first("points").alias("points"))
        classes.append(Written(own, "classes"))
        discard(spark, f"{every.path}/part={i}")
        _settle(spark)
    every.drop()
    queries = _all(classes).where("query")
    pairs = candidates(queries, _all(classes).where("NOT query"))
    asked, links = Written(_without_unsure(queries), "asked"), []
    slices = max(LEAST_SLICES, pairs.df.count() // PARTS // SLICE, rows.df.count() // PARTS // SLICE)
    for i, own in enumerate(classes):
        links.append(Written(confirmed(pairs.df.where(part == i), asked.df, own.df.where("NOT query"), slices), "links"))
        _settle(spark)
    asked.drop()
    pairs.drop()
    return rows.df, _all(classes), _all(links)


def op2_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page: the smallest page with the same picture, its keypoints, and the queries that link to it (n_links). For a
    page whose id is divisible by 50 also whether its edited copy links to its picture (found), to how many pictures it
    links (n_found) and to which best (best_id, the smallest page with that picture)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), "html")
    rows, classes, links = find_copies(described(pages, ["page_id", "html"], drawn_pages))
    n_queries = rows.where("query").groupBy(F.col("cid").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    n_links = links.join(n_queries, "q").groupBy("cid").agg(F.sum("n").alias("n_links"))
    pictures_ = rows.where("NOT query").groupBy("cid").agg(F.min("id").alias("picture_id"))
    pictures_ = pictures_.join(classes.where("NOT query").select("cid", F.floor(F.octet_length("points") / _RECORD.itemsize).alias("n_keypoints")), "cid").join(n_links, "cid", "left")
    pictures_ = Written(pictures_, "pictures").df
    hits = links.join(pictures_.select("cid", "picture_id"), "cid")
    best = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n_found"), F.min_by("picture_id", F.struct(-F.col("inliers"), "picture_id")).alias("best_id"))
    asked = rows.where("query").select(F.col("id").alias("page_id"), F.col("cid").alias("q"))
    own = rows.where("NOT query").select(F.col("id").alias("page_id"), "cid")
    linked = links.select("q", "cid", F.lit(True).alias("linked"))
    found = asked.join(own, "page_id").join(linked, ["q", "cid"], "left").join(best, "q", "left")
    found = found.groupBy("page_id").agg(F.max(F.coalesce("linked", F.lit(False))).alias("found"), F.max(F.coalesce("n_found", F.lit(0))).alias("n_found"), F.min("best_id").alias("best_id"))
    out = own.join(pictures_, "cid").join(found, "page_id", "left")
    return out.select("page_id", "picture_id", "n_keypoints", F.coalesce("n_links", F.lit(0)).alias("n_links"), "found", "n_found", "best_id")

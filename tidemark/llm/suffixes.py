"""Suffix sorting by external induction, with common prefixes carried along.

The order of all suffixes of a text of whole numbers is induced from that of its LMS suffixes (those that start an
ascent after a descent), and theirs from the reduced text of the names of the pieces between them, recursively, on every
level by the same code.

Queues. Induction takes suffix tuples (symbol, place, common prefix with the tuple before it) from a priority queue in
order and puts the suffix one place before each back in. Priorities are (symbol, arrival). A queue keeps MEMORY tuples;
beyond them it writes them to disk, in ranges of symbols, each of which is read back in its turn and sorted, or dealt again
if it is too large. Tuples are taken in the longest row within which no new tuple falls, so that a row is worked on at once.

Common prefixes. Of two neighbours c + x and c + y the common prefix is one c longer than that of x and y, which is the
least among those of all tuples taken between x and y. Within a row that is a range minimum; across rows each symbol
keeps the least since its last tuple, and the rows' own minima lie on a stack. Where a symbol's descending suffixes meet
its ascending ones, the two are compared directly. Values are counted in symbols of the first text, up to a limit that
the caller gives.

Naming. Pieces are sorted by the same induction from LMS suffixes that are ordered by symbol, length of the symbol's run
and the symbol after it, and that count as equal where these are; two pieces are equal where the value says so. The
common prefix of pieces with different names is thus that of any suffixes that start with them. It goes down into the
recursion with the length of each piece.

Text, kinds of suffixes, names and what symbols keep are files mapped into memory, whatever their size; queues, rows and
blocks have fixed bounds. Files lie in the task's temporary folder and go with it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples a queue keeps in memory, and the most that are worked on at once.
MEMORY, BLOCK = 1 << 19, 1 << 16
#: Bins of a queue.
BINS = 256
#: The common prefix of pieces that are equal as far as they go.
EQUAL = 1 << 40
#: Tuples are the columns of arrays with these rows.
SYMBOL, AT, LCP = range(3)
_NONE = np.empty((3, 0), np.int64)


def mapped(n: int, kind: str) -> np.ndarray:
    """An array of zeros in a file."""
    with tempfile.TemporaryFile() as file:
        return np.asarray(np.memmap(file, np.dtype(kind), "w+", shape=(max(n, 1),)))[:n]


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + BLOCK)) for a in range(0, n, BLOCK))


def _order(symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """Stable; symbols of 16 bits are sorted by their digits."""
    return np.argsort(symbols.astype(np.uint16) if n_symbols <= 1 << 16 else symbols, kind="stable")


def _by_symbol(rows: np.ndarray) -> np.ndarray:
    return rows[:, np.argsort(rows[SYMBOL], kind="stable")]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1) if parts else _NONE


# --- queues


class _File:
    """Tuples on disk, added at the end and read anywhere."""

    def __init__(self):
        self.file, self.n = tempfile.TemporaryFile(), 0

    def put(self, rows: np.ndarray) -> tuple[int, int]:
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(rows.T).tobytes())
        self.n += rows.shape[1]
        return self.n - rows.shape[1], rows.shape[1]

    def read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(24 * at)
        return np.ascontiguousarray(np.frombuffer(self.file.read(24 * n), np.int64).reshape(-1, 3).T)


class _Bin:
    """The tuples of a range of symbols: those sorted already, or a queue of them, then those on disk and in memory as they
    came."""

    def __init__(self):
        self.head, self.inner, self.on_disk, self.parts = _NONE, None, [], []


class Queue:
    """Tuples of symbols from `low` to below `high`, by symbol and, where these are equal, as they came. What is put in is
    never below what was taken out.

    Symbols fall into BINS ranges. The first range with tuples is sorted, or is a queue of its own if it does not fit into
    memory; a range of one symbol is in order as it is and is read in blocks."""

    def __init__(self, low: int, high: int):
        self.low, self.width = low, -(-(high - low) // BINS)
        self.bins = [_Bin() for _ in range(-(-(high - low) // self.width))]
        self.turn, self.in_memory, self.spilled, self.file = len(self.bins), 0, 0, None

    def put(self, rows: np.ndarray) -> None:
        """Rows in order of their symbols."""
        if not rows.shape[1]:
            return
        of = (rows[SYMBOL] - self.low) // self.width
        cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
        self.turn = min(self.turn, int(of[0]))
        for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
            bin_ = self.bins[of[a]]
            if bin_.inner:
                bin_.inner.put(rows[:, a:b])
            else:
                bin_.parts.append(rows[:, a:b])
                self.in_memory += b - a
        if self.in_memory > MEMORY:
            self.file = self.file or _File()
            for bin_ in self.bins:
                if bin_.parts:
                    bin_.on_disk.append(self.file.put(_joined(bin_.parts)))
                    bin_.parts = []
            self.spilled += self.in_memory
            self.in_memory = 0

    def _read(self, bin_: _Bin, n: int) -> Iterator[np.ndarray]:
        """At least n tuples of a bin, or all, in blocks as they came; they leave it."""
        while bin_.on_disk and n > 0:
            at, k = bin_.on_disk.pop(0)
            if k > BLOCK:
                bin_.on_disk.insert(0, (at + BLOCK, k - BLOCK))
                k = BLOCK
            n -= k
            yield self.file.read(at, k)
        if n > 0 and bin_.parts:
            rows, bin_.parts = _joined(bin_.parts), []
            self.in_memory -= rows.shape[1]
            yield rows

    def peek(self, n: int) -> np.ndarray:
        """The first tuples, n of them or as many as lie at hand; none only if there are none."""
        for self.turn in range(self.turn, len(self.bins)):
            bin_ = self.bins[self.turn]
            if bin_.inner:
                if (rows := bin_.inner.peek(n)).shape[1]:
                    return rows
                bin_.inner = None
            if bin_.parts or bin_.on_disk:
                if self.width == 1:
                    if bin_.head.shape[1] < n:
                        bin_.head = _joined([bin_.head, *self._read(bin_, n - bin_.head.shape[1])])
                elif sum(k for _, k in bin_.on_disk) + sum(x.shape[1] for x in bin_.parts) + bin_.head.shape[1] > MEMORY:
                    start = self.low + self.turn * self.width
                    bin_.inner = Queue(start, start + self.width)
                    bin_.inner.put(bin_.head)
                    bin_.head = _NONE
                    for rows in self._read(bin_, EQUAL):
                        bin_.inner.put(_by_symbol(rows))
                    return bin_.inner.peek(n)
                else:
                    head = _joined([bin_.head, *self._read(bin_, EQUAL)])
                    bin_.head = head[:, _order(head[SYMBOL] - (self.low + self.turn * self.width), self.width)]
            if bin_.head.shape[1]:
                return bin_.head[:, :n]
        self.turn = len(self.bins)
        return _NONE

    def skip(self, n: int) -> None:
        """Take the first n of those that peek showed."""
        if n:
            bin_ = self.bins[self.turn]
            if bin_.inner:
                bin_.inner.skip(n)
            else:
                bin_.head = bin_.head[:, n:]


class Tape:
    """Tuples in a file, written once and read from the end; each then has the common prefix that was noted at the one
    behind it."""

    def __init__(self):
        self.file, self.left, self.rows, self.next = _File(), 0, _NONE, 0

    def put(self, rows: np.ndarray) -> None:
        self.file.put(rows)
        self.left += rows.shape[1]

    def changed(self, rows: np.ndarray) -> np.ndarray:
        return rows

    def peek(self, n: int) -> np.ndarray:
        if self.rows.shape[1] < n and self.left:
            k = min(max(n, BLOCK), self.left)
            self.left -= k
            more = self.file.read(self.left, k)[:, ::-1].copy()
            lcp = more[LCP].copy()
            more[LCP, 0], more[LCP, 1:], self.next = self.next, lcp[:-1], int(lcp[-1])
            self.rows = _joined([self.rows, self.changed(more)])
        return self.rows[:, :n]

    def skip(self, n: int) -> None:
        self.rows = self.rows[:, n:]


# --- texts


class _Level:
    """A text of symbols below n_symbols; its last symbol is 0 and stands nowhere else. weight: symbols of the first text
    that a symbol stands for; cross: the common prefix of a symbol's piece with that of the symbol below; origin: where
    its places lie in the first text, of which `before` counts what lies before each place."""

    def __init__(self, text: np.ndarray, n_symbols: int, cap: int, weight, before: np.ndarray, cross=None, origin=None, first=None):
        self.n_symbols, self.cap = n_symbols, cap
        self.weight, self.before, self.cross, self.origin = weight, before, cross, origin
        self.first = text if first is None else first
        n = len(text)
        # twice the symbol, and 1 where the suffix is smaller than the one after it
        self.code, self.run = mapped(n, "<i8"), mapped(n, "<i4")
        after, longer = True, 0
        for to in range(n, 0, -BLOCK):
            at = max(0, to - BLOCK)
            here, there = np.asarray(text[at:to], np.int64), np.asarray(text[at + 1 : to + 1], np.int64)
            step = np.zeros(to - at, np.int8)
            step[: len(there)] = np.sign(there - here[: len(there)])
            if len(there) < len(here):
                step[-1] = 1
            place = np.arange(to - at)
            # a run of equal symbols goes as its end goes
            end = np.minimum.accumulate(np.where(step != 0, place, to - at)[::-1])[::-1]
            open_ = end == to - at
            rises = np.where(open_, after, step[np.minimum(end, to - at - 1)] > 0)
            self.code[at:to] = 2 * here + rises
            self.run[at:to] = np.minimum(np.where(open_, to - at - place + longer, end - place + 1), cap)
            after, longer = bool(rises[0]), int(self.run[at])

    def across(self, symbols: np.ndarray) -> np.ndarray:
        """The common prefixes of neighbours in a row of symbols, each larger than the one before."""
        lo, hi = int(symbols[0]), int(symbols[-1])
        return np.minimum.reduceat(self.cross[lo + 1 : hi + 1], symbols[:-1] - lo).astype(np.int64)

    def compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes at a and b, compared."""
        out = np.full(len(a), self.cap, np.int64)
        if self.origin is not None:
            a, b = self.origin[a], self.origin[b]
        a, b = a.astype(np.int64), b.astype(np.int64)
        open_, last = np.arange(len(a)), len(self.first) - 1
        for k in range(self.cap):
            if not len(open_):
                break
            x, y = a[open_] + k, b[open_] + k
            # the last symbol stands at one place only, so that nothing is compared past it
            same = self.first[np.minimum(x, last)] == self.first[np.minimum(y, last)]
            out[open_[~same]] = np.minimum(self.before[x[~same]] - self.before[a[open_[~same]]], self.cap)
            open_ = open_[same]
        return out


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of a[lo] to a[hi]."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out, width = np.empty(len(lo), a.dtype), 1
    for j in range(int(level.max()) + 1):
        at = np.flatnonzero(level == j)
        if len(at):
            out[at] = np.minimum(a[lo[at]], a[hi[at] - width + 1])
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return out


def _sweep(level: _Level, queue: Queue, source: Tape | Queue, up: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Take tuples of the queue, and behind those of their symbol those of the source, from the least symbol up or from
    the greatest down, and put those one place before them into the queue: the descending ones on the way up, the
    ascending ones on the way down. Yields the rows taken and which of them are the source's. Symbols are counted from
    where the way starts."""
    code, top = level.code, level.n_symbols - 1
    since, tail = mapped(level.n_symbols, "<i8"), mapped(level.n_symbols, "<i8")
    stack_row, stack_min = [0], [-1]
    number, block, last = 0, 256, None
    while True:
        q, s = queue.peek(block), source.peek(block)
        n_queue = q.shape[1]
        if not s.shape[1]:
            if not n_queue:
                return
            rows, of_source = q, np.zeros(n_queue, np.bool_)
        else:
            # either may hold more than it shows: what it shows last is as far as is known
            if n_queue and n_queue < block and s[SYMBOL, -1] >= q[SYMBOL, -1]:
                s = s[:, : np.searchsorted(s[SYMBOL], q[SYMBOL, -1])]
            elif n_queue and s.shape[1] < block and s[SYMBOL, -1] < q[SYMBOL, -1]:
                q = q[:, : np.searchsorted(q[SYMBOL], s[SYMBOL, -1], side="right")]
                n_queue = q.shape[1]
            rows = np.concatenate((q, s), axis=1)
            order = np.argsort(rows[SYMBOL], kind="stable")[:block]
            rows, of_source = rows[:, order], order >= n_queue
        number += 1
        key, before = rows[SYMBOL], rows[AT] - 1
        target = code[before]
        goes = ((target & 1) != up) & (before >= 0)
        target = target >> 1
        target = np.where(goes, target if up else top - target, EQUAL)
        least = np.minimum.accumulate(target)
        fits = (least > key) | ((least == key) & ~of_source)
        k = len(fits) if fits[-1] else int(fits.argmin())
        block = min(BLOCK, max(256, 2 * k))
        if k < len(fits):
            rows, of_source, key, target, before = rows[:, :k], of_source[:k], key[:k], target[:k], before[:k]
        n_source = int(np.count_nonzero(of_source))
        queue.skip(k - n_source)
        source.skip(n_source)

        # common prefixes with the tuple taken before
        rows = rows.copy()
        key, places, lcp = rows
        if last is None:
            last = (int(key[0]), bool(of_source[0]), int(places[0]))
            lcp[0] = 0
        earlier = np.concatenate(((last[0],), key[:-1]))
        changed = key != earlier
        changes = np.flatnonzero(changed)
        if len(changes):
            if level.cross is None:
                lcp[changes] = 0
            else:
                symbols = np.concatenate((earlier[changes[:1]], key[changes]))
                lcp[changes] = level.across(symbols) if up else level.across((top - symbols)[::-1])[::-1]
        if n_source:
            meets = of_source & ~changed
            meets[1:] &= ~of_source[:-1]
            meets[0] &= not last[1]
            meets = np.flatnonzero(meets)
            if len(meets):
                lcp[meets] = level.compared(np.concatenate(((last[2],), places[:-1]))[meets], places[meets])
        last = (int(key[-1]), bool(of_source[-1]), int(places[-1]))

        i = np.flatnonzero(target < EQUAL)
        low = int(lcp.min())
        if len(i):
            i = i[_order(target[i], level.n_symbols)]
            to = target[i]
            new = np.empty(len(i), np.bool_)
            new[0] = True
            np.not_equal(to[1:], to[:-1], out=new[1:])
            least = _range_min(lcp, np.where(new, 0, np.concatenate(((0,), i[:-1] + 1))), i)
            at = to[new]
            between = np.minimum(tail[at], np.array(stack_min + [EQUAL])[np.searchsorted(stack_row, since[at], side="right")])
            least[new] = np.minimum(least[new], between)
            out = np.empty((3, len(i)), np.int64)
            out[SYMBOL], out[AT] = to, before[i]
            out[LCP] = np.where(least >= EQUAL, EQUAL, np.minimum(least + level.weight[to if up else top - to], level.cap))
            queue.put(out)
            ends = i[np.append(new[1:], True)]
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], EQUAL)
            since[at], tail[at] = number, rest[ends + 1]
        while stack_min and stack_min[-1] >= low:
            stack_row.pop()
            stack_min.pop()
        stack_row.append(number)
        stack_min.append(low)
        yield rows, of_source


def _induced(level: _Level, seeds: Tape | Queue) -> Iterator[np.ndarray]:
    """All suffixes from the greatest to the least, with their common prefix with the one before, from LMS suffixes in
    order."""
    descending = Tape()
    for rows, of_source in _sweep(level, Queue(0, level.n_symbols), seeds, True):
        descending.put(rows[:, ~of_source])
    top = level.n_symbols - 1

    def turned(rows: np.ndarray) -> np.ndarray:
        rows[SYMBOL] = top - rows[SYMBOL]
        return rows

    descending.changed = turned
    queue = Queue(0, level.n_symbols)
    # the last suffix is the smallest of all and belongs to no descent
    queue.put(np.array([[top], [len(level.code) - 1], [0]]))
    for rows, _ in _sweep(level, queue, descending, False):
        yield rows


def _taken(queue: Queue) -> Iterator[np.ndarray]:
    while (rows := queue.peek(BLOCK)).shape[1]:
        queue.skip(rows.shape[1])
        yield rows.copy()


def _rough_seeds(level: _Level, lms: np.ndarray) -> Queue:
    """LMS suffixes by symbol, run (longer ones are less) and the symbol after it; equal ones are EQUAL."""
    n_symbols, wide = level.n_symbols, level.cap + 1
    by_after, by_symbol, out = Queue(0, n_symbols), Queue(0, n_symbols * wide), Queue(0, n_symbols)
    last = len(level.code) - 1
    for a, b in _blocks(len(lms)):
        at = lms[a:b]
        by_after.put(_by_symbol(np.stack((level.code[np.minimum(at + level.run[at], last)] >> 1, at, np.zeros_like(at)))))
    for after, at, _ in _taken(by_after):
        by_symbol.put(_by_symbol(np.stack(((level.code[at] >> 1) * wide + (level.cap - level.run[at]), at, after))))
    before = np.full((3, 1), -wide)
    for rows in _taken(by_symbol):
        both = np.concatenate((before, rows), axis=1)
        before = both[:, -1:]
        differs = np.flatnonzero((both[SYMBOL, 1:] != both[SYMBOL, :-1]) | (both[LCP, 1:] != both[LCP, :-1]))
        rows[LCP] = EQUAL
        rows[SYMBOL] //= wide
        same = differs[rows[SYMBOL, differs] == both[SYMBOL, differs] // wide]
        rows[LCP, same] = level.compared(both[AT, same], rows[AT, same])
        out.put(rows)
    return out


def _sorted(level: _Level) -> Iterator[np.ndarray]:
    """All suffixes of a level from the greatest to the least."""
    n = len(level.code)
    if n == 1:
        yield np.zeros((3, 1), np.int64)
        return
    lms, n_lms = mapped(n // 2 + 1, "<i8"), 0
    is_lms = mapped(n, "?")
    for a, b in _blocks(n):
        rises = level.code[max(a - 1, 0) : b] & 1
        found = np.flatnonzero(rises[1:] > rises[:-1]) + max(a, 1)
        lms[n_lms : n_lms + len(found)] = found
        is_lms[found] = True
        n_lms += len(found)
    lms = lms[:n_lms]

    # names of the pieces, from the greatest down; cross[i] is what names i - 1 and i have in common
    names, cross = mapped(n_lms, "<i8"), mapped(n_lms + 1, "<i4")
    name, low = -1, EQUAL
    for rows in _induced(level, _rough_seeds(level, lms)):
        found = np.flatnonzero(is_lms[rows[AT]])
        if not len(found):
            low = min(low, int(rows[LCP].min()))
            continue
        least = _range_min(rows[LCP], np.concatenate(((0,), found[:-1] + 1)), found)
        least[0] = min(low, int(least[0]))
        low = int(rows[LCP, found[-1] + 1 :].min(initial=EQUAL))
        new = least < EQUAL
        new[0] |= name < 0
        at = name + np.cumsum(new)
        names[np.searchsorted(lms, rows[AT, found])] = at
        cross[at[new]] = np.minimum(least[new], level.cap)
        name = int(at[-1])
    n_names = name + 1
    below, weight, origin = mapped(n_names, "<i4"), mapped(n_names, "<i4"), mapped(n_lms, "<i8")
    for a, b in _blocks(n_names):
        below[n_names - b : n_names - a] = cross[a + 1 : b + 1][::-1]
    count = mapped(n_names, "<i8")
    for a, b in _blocks(n_lms):
        names[a:b] = n_names - 1 - names[a:b]
        np.add.at(count, names[a:b], 1)
        origin[a:b] = lms[a:b] if level.origin is None else level.origin[lms[a:b]]
    for a, b in _blocks(n_lms):
        ahead = level.before[origin[a + 1 : b + 1]]
        weight[names[a : a + len(ahead)]] = np.minimum(ahead - level.before[origin[a : a + len(ahead)]], level.cap)
    weight[0] = 1

    # no comparison gets past a name that stands once, so that of several in a row only the first is needed
    kept, n_kept, single = mapped(n_lms, "<i8"), 0, mapped(n_names, "<i8")
    for a, b in _blocks(n_lms):
        once = count[names[a:b]] == 1
        goes = once & np.concatenate(([a > 0 and count[names[a - 1]] == 1], once[:-1]))
        if b == n_lms:
            goes[-1] = False
        single[names[a:b][goes]] = np.flatnonzero(goes) + a + 1
        stays = np.flatnonzero(~goes) + a
        kept[n_kept : n_kept + len(stays)] = stays
        n_kept += len(stays)
    kept = kept[:n_kept]
    text, place = mapped(n_kept, "<i8"), mapped(n_kept, "<i8")
    for a, b in _blocks(n_kept):
        text[a:b], place[a:b] = names[kept[a:b]], origin[kept[a:b]]

    seeds, above = Tape(), n_names
    for rows in _sorted(_Level(text, n_names, level.cap, weight, level.before, below, place, level.first)):
        at = kept[rows[AT]]
        name = names[at]
        low = int(name[-1])
        others = np.flatnonzero(single[low:above])[::-1] + low
        out = np.stack((np.concatenate((name, others)), np.concatenate((at, single[others] - 1)), np.concatenate((rows[LCP], np.zeros_like(others)))))
        out = out[:, np.argsort(-out[SYMBOL], kind="stable")]
        new = np.flatnonzero(np.diff(out[SYMBOL], prepend=above))
        # every name is there: the one before is the next larger
        out[LCP, new] = below[np.minimum(out[SYMBOL, new] + 1, n_names - 1)]
        above = low
        seeds.put(out)

    def placed(rows: np.ndarray) -> np.ndarray:
        rows[AT] = lms[rows[AT]]
        rows[SYMBOL] = level.code[rows[AT]] >> 1
        return rows

    seeds.changed = placed
    yield from _induced(level, seeds)


def suffixes(text: np.ndarray, n_symbols: int, cap: int, weight: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Blocks of rows symbol, at and lcp: the suffixes of a text of numbers below n_symbols from the greatest to the least,
    each with the common prefix, up to cap, that it has with the one before; a symbol counts as its weight, or 1. The
    text's last symbol must be 0 and stand nowhere else."""
    n, at = len(text), 0
    own = np.ones(n_symbols, np.int32) if weight is None else weight
    before = mapped(n, "<i8")
    for a, b in _blocks(n):
        ends = at + np.cumsum(own[text[a:b]], dtype=np.int64)
        before[a:b] = ends - own[text[a:b]]
        at = int(ends[-1])
    return _sorted(_Level(text, n_symbols, cap, own, before))

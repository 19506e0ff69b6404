"""Which files a compaction takes."""

from tidemark.model import FileMeta, Options
from tidemark.operators import compaction as C

OPT = Options(max_file_size=1000, level_bytes=1000)


def f(no, level, lo, hi, size=100):
    return FileMeta(level, no, f"tables/{no}", size, 1, lo.encode(), hi.encode(), no, no)


def test_overlap_grows_on_level_0_only():
    files = [f(1, 0, "a", "c"), f(2, 0, "b", "e"), f(3, 0, "d", "g"), f(4, 0, "x", "z")]
    assert [x.file_no for x in C.overlapping(files, 0, b"a", b"a")] == [1, 2, 3]
    deeper = [f(x.file_no, 1, x.smallest_k.decode(), x.largest_k.decode()) for x in files]
    assert [x.file_no for x in C.overlapping(deeper, 1, b"a", b"a")] == [1]
    assert len(C.overlapping(files, 0, None, None)) == 4
    assert C.overlapping(files, 0, b"h", b"w") == []


def test_boundary_files_chain():
    files = [f(1, 1, "a", "c"), f(2, 1, "c", "e"), f(3, 1, "e", "g"), f(4, 1, "h", "i")]
    assert [x.file_no for x in C.with_boundary_files(files, [files[0]])] == [1, 2, 3]


def test_scores_and_pick():
    files = [f(i, 0, "a", "c") for i in range(1, 5)]
    assert C.scores(files, OPT)[0] == 1
    assert {x.file_no for x in C.pick(files, {}, OPT).inputs} == {1, 2, 3, 4}
    assert C.pick(files[:3], {}, OPT) is None
    assert C.scores([f(1, 1, "a", "b", 500), f(2, 2, "a", "b", 500)], OPT)[1:3] == [0.5, 0.05]
    # a tie goes to the first level
    tie = [f(i, 0, "a", "c") for i in range(1, 5)] + [f(9, 1, "x", "y", 1000)]
    assert C.pick(tie, {}, OPT).level == 0


def test_turns():
    files = [f(1, 1, "a", "c", 900), f(2, 1, "d", "f", 900)]
    first = C.pick(files, {}, OPT)
    assert first.inputs[0].file_no == 1
    assert C.pick(files, {1: first.pointer}, OPT).inputs[0].file_no == 2
    assert C.pick(files, {1: b"z"}, OPT).inputs[0].file_no == 1


def test_trivial_move():
    files = [f(1, 1, "a", "c", 2000), f(2, 2, "x", "z")]
    assert C.pick(files, {}, OPT).is_trivial
    assert not C.pick([*files, f(3, 2, "b", "d")], {}, OPT).is_trivial
    # too much of level 3 below it
    assert not C.pick([files[0], f(4, 3, "a", "c", 11_000)], {}, OPT).is_trivial


def test_expansion_needs_an_unchanged_lower_level():
    files = [f(1, 1, "a", "c", 2000), f(2, 1, "d", "f", 10), f(3, 2, "a", "f", 10)]
    c = C.Compaction(1, [files[0]], files, OPT)
    assert [x.file_no for x in c.inputs] == [1, 2] and [x.file_no for x in c.lower] == [3]
    more = [*files[:2], f(3, 2, "a", "e", 10), f(4, 2, "f", "h", 10)]
    assert [x.file_no for x in C.Compaction(1, [more[0]], more, OPT).inputs] == [1]


def test_flush_level():
    assert C.flush_level([], b"a", b"b", 1, OPT) == 2
    assert C.flush_level([f(1, 0, "a", "c")], b"b", b"d", 1, OPT) == 0
    assert C.flush_level([f(1, 2, "a", "c")], b"b", b"d", 1, OPT) == 1
    # level 2 would lie over too much of level 3
    assert C.flush_level([f(1, 3, "a", "c", 20_000)], b"b", b"d", 1, OPT) == 1

import zlib

import cases
import numpy as np
import pytest
from tidemark.llm import packing as P
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.vocabulary())


def test_pieces(spark, tok):
    rows = cases.rows()
    got = P.pack(cases.documents(spark), length=128).collect()
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for i, own in ids.items():
        starts = sorted((r.start, r.length) for r in got if r.doc_id == i)
        n = sum(x[0] == i for x in rows)
        assert sum(length for _, length in starts) == n * len(own)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, xs in sequences.items():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at == 128 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


TEXTS = ["", "a", "Hello, World!!", "it's we'll 'tis", "<|endoftext|> x<|startoftext|>", "<|ENDOFTEXT|>", "é É ß Σς ſ", "naïve,café.", "a b　c d", "12 345½", "中文，字", "x.y...z", "word*** &&& a|b", "\x0b\x1c\x85", "😀!a", "a‍b", "ŉ ǅ İ ª.", "A" * 300 + "." * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_give_the_ids_of_the_text(tok, text):
    encode, code = P._encoder(P.vocabulary())
    for t in (text, text + " " + text, f"x{text}\n"):
        assert np.frombuffer(encode(t.encode()), code).tolist() == tok.encode(t, add_special_tokens=False).ids + [1]


def test_empty(spark):
    assert P.pack(cases.empty(spark)).count() == 0

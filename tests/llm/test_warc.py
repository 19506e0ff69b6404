import base64
import hashlib
import io

import pytest
from tidemark.llm import warc as W
from tidemark.llm.common import new_folder

PAGES = [(3, "http://a/", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None), (5, "e", ""), (7, "é\r\nx", "WARC/1.1\r\n\r\n\r\n" * 50), (None, "n", "<p>x</p>"), (8, "big", "äb" * 300_000), (1, "u", "<p>x</p>"), (9, "gz", "\x1f\x8b\r\n\r\n")]


def written(pages=PAGES):
    return b"".join(W.record(i, (u or "").encode(), (h or "").encode(), W.digest((h or "").encode()), None, False) for i, u, h in pages)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_sequential_reading(chunk):
    small = [p for p in PAGES if p[0] != 8] if chunk == 1 else PAGES
    got = [m for _, m in W.members(io.BytesIO(written(small)), chunk)]
    assert len(got) == len(small) and all(m.startswith(b"WARC/1.1\r\n") for m in got)
    assert [r["payload"] for r in W.read_records(io.BytesIO(written()))] == [(h or "").encode() for _, _, h in PAGES]


def test_damage_is_found():
    data = written()
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(data[:-3])))
    import gzip

    one = W.record(1, b"u", b"hello", W.digest(b"hello"), None, False)
    plain = gzip.decompress(one)
    for bad in (plain.replace(b"hello", b"hellO"), plain.replace(b"WARC/1.1", b"WARC/0.9"), plain + b"x", plain.replace(b"\r\n\r\n", b"\r\n", 1)[:40]):
        with pytest.raises((ValueError, KeyError)):
            list(W.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(W.read_records(io.BytesIO(b"not gzip")))


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, sha string, first string").repartition(3)
    archives = W.write_archives(pages, new_folder(spark, "test"))
    got = W.read_archives(archives).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = first[h or ""] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else b))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got), key=repr) == sorted(want, key=repr)


def test_least_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = W.read_archives(W.write_archives(pages, new_folder(spark, "test"), least=100)).collect()
    assert {r.record_type for r in got} == {"response"} and len(got) == len(PAGES)
    none = W.write_archives(pages.limit(0), new_folder(spark, "test"))
    assert W.read_archives(none).count() == 0

import hashlib
import random
import re

import cases
from tidemark.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    return {"email": True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(t):
    return sorted((m.start(), o, m.end(), k) for o, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if holds(k, m[0]))


def made(n=400):
    r = random.Random(4)
    parts = ["a@b.c", ".@x.y", "é", " ", "中", "-", "+1", "(555)", "555-", "1234", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "256.1.1.1", "0001.2.3.004", ".", "5", "@", "a", "\n", "+49 30 1234567", "😀", "_", "a.b-c@d-e.f.g", "00000000000000", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans(spark, tmp_path):
    texts = [*made(), None, "", "a" * 200_000, "a." * 50_000 + "@", "1." * 50_000, "1 " * 50_000, "+" + "1(" * 50_000, "x@" + "a." * 50_000 + "b"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id][:200], r.spans, said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in BASE]
        own = [x for x in r.spans.split(",") if x.split(":")[0] in BASE]
        assert own == [x for x in said.split(",") if x] or not said and own == []


def test_more_kinds(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33", "ssn: 123-45-6789", "part 123-45-6789", "my card 4111111111111111", "4111111111111111"]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, texts)).collect()}
    assert [[s.kind for s in got[i]] for i in range(6)] == [["iban"], [], ["ssn"], [], ["card"], ["card"]]
    assert got[0][0].value == "GB82 WEST 1234 5698 7654 32" and texts[0][got[0][0].start : got[0][0].end] == got[0][0].value
    assert got[4][0].score > got[5][0].score


def test_iban_before_words_and_numbers(spark):
    """What follows an IBAN after a blank is not taken for a part of it."""
    de, gb = "DE89370400440532013000", "GB82WEST12345698765432"
    want = [(f"{de} Bank of X", [de]), ("DE89 3704 0044 0532 0130 00 Please", ["DE89 3704 0044 0532 0130 00"]), (f"{gb} IBAN", [gb]), (f"{gb} 2024", [gb]), (f"{gb} {de}", [gb, de]), (f"KD12 {de} 7", [de]), (f"{de}X", []), (f"{de[:-1]} Bank", [])]
    got = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, [t for t, _ in want])).collect()}
    for i, (text, values) in enumerate(want):
        spans = [s for s in got[i] if s.kind == "iban"]
        assert [s.value for s in spans] == values and [text[s.start : s.end] for s in spans] == values
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, [t for t, _ in want])).collect()}
    assert clean[0] == "[IBAN] Bank of X" and clean[3] == "[IBAN] 2024"


def test_redact(spark):
    docs = cases.documents(spark)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=repr) == sorted(cases.rows(), key=repr)
    texts = made()
    found = frame(spark, texts)
    for r in pii.redact(found.selectExpr("*", "bigint(length(text)) n_chars")).collect():
        out, at = "", 0
        for a, _, b, k in brute(texts[r.doc_id]):
            if a >= at:
                out += texts[r.doc_id][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert r.text == out + texts[r.doc_id][at:] and r.n_chars == len(r.text)


def test_empty_and_native(spark):
    found = pii.find_pii(cases.empty(spark))
    assert found.count() == 0
    plan = pii.find_pii(cases.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_many_matches_in_one_text(spark):
    """Time grows with the text, not with the square of its matches."""
    import time

    text = " ".join(f"{i % 9000 + 1000}x" for i in range(170_000)) + " a@b.cd" * 2_000
    assert len(text) > 1_000_000
    took = []
    for t in (text[-40_000:], text):
        started = time.perf_counter()
        got = pii.find_pii(frame(spark, [t])).collect()[0].spans
        took.append(time.perf_counter() - started)
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer("a@b.cd", text)]
    assert took[1] < 30

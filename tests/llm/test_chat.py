import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from tidemark.llm import chat as C

hard = st.lists(st.sampled_from([*"<|\\>\na im_start", "<|im_end|>", "<|im_start|>", "é", "😀"]), max_size=20).map("".join)


@given(hard)
def test_escapes(x):
    assert C.unescape(C.escape(x)) == x and "<|" not in C.escape(x)
    assert C.unescape_role(C.escape_role(x)) == x and "\n" not in C.escape_role(x) and "<|" not in C.escape_role(x)


@given(st.lists(st.tuples(hard, hard), max_size=5), st.integers(1, 40))
def test_round_trip(turns, size):
    out = "".join(t for t, _ in C.compile_template(C.DEFAULT)(messages=[{"role": r, "text": t} for r, t in turns]))
    back = []
    reader = C.Reader(lambda r, t: back.append((r, t)))
    for at in range(0, len(out), size):
        reader.feed(out[at : at + size])
    reader.close()
    assert back == turns


def render(template, **names):
    return "".join(t for t, _ in C.compile_template(template)(**names))


@pytest.mark.parametrize(
    "template, out",
    [
        ("a{{ 1 + 2 }}b", "a3b"),
        ("{{ x.y['z'][1] }}", "q"),
        ("{% for i in l %}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1,2,3"),
        ("{% for i in l %}{{ loop.index }}{{ loop.first }};{% endfor %}", "1true;2false;3false;"),
        ("{% if n %}n{% elif l | length == 3 %}three{% else %}e{% endif %}", "three"),
        ("{% if n %}n{% elif n %}x{% else %}e{% endif %}", "e"),
        ("{% set a = 'x' ~ 2 %}{{ a | upper }}", "X2"),
        ("  {%- if true -%}  y  {%- endif %} z", "y z"),
        ("{{ 'a' if n else 'b' }}{{ 'a' in 'cat' and 2 in l }}", "btrue"),
        ("{{ missing }}{{ x.missing.more }}{{ none }}", ""),
        ("{{ x.__class__ }}{{ l.append }}{{ s.upper }}", ""),
        (r"{{ 'it\'s\n' }}", "it's\n"),
    ],
)
def test_language(template, out):
    assert render(template, x={"y": {"z": ["p", "q"]}}, l=[1, 2, 3], n=0, s="s") == out


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endfor %}", "{{ f(1) }}", "{{ x | open }}", "{% import os %}", "{{ 'a }}", "{{ }}", "{% for x %}{% endfor %}", "{{ a b }}", "{% if x %}{% endfor %}"])
def test_errors(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_folding():
    tree = C.fold(C.parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}{{ 'z' if true else y }}"))
    assert tree == [C.Text("abCdz")]
    assert C.fold(C.parse("{{ 'a' + 1 }}")) != []  # what fails waits for the rendering


def test_generation_marks():
    got = list(C.compile_template("{% for m in messages %}{{ m }}{% generation %}[{{ m }}{% if m %}!{% endif %}]{% endgeneration %}{% endfor %}")(messages=["a"]))
    assert "".join(t for t, g in got if g) == "[a!]" and "".join(t for t, g in got) == "a[a!]"


def test_conversations(spark):
    r = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "é😀", "text ", "\n"]
    rows = [(c, t, r.choice(["user", "assistant", None, "a\nb"]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 9))), "clash") for c in [*range(20), None] for t in [*range(r.randint(1, 6)), None, 0]]
    rows += [(77, i, "assistant" if i % 2 else "user", "long " * 3000, "clash") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    for size in (1 << 18, 50):
        got = {x.conv_id: x for x in C.read_back(C.format_conversations(df, piece=size)).collect()}
        for c in {x[0] for x in rows}:
            own = sorted(((t is not None, t or 0, ro or "", tx or "") for k, t, ro, tx, _ in rows if k == c))
            learnt = "".join(t for _, _, ro, t in own if ro == "assistant")
            said = "".join(f"{ro}\n{t}\n" for _, _, ro, t in own)
            x = got[c]
            assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
            assert x.formatted_chars >= len(said)
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0

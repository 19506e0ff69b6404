import collections
import random
import re

import cases
from tidemark.llm import licenses as L


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_labels(t, templates, containment):
    """All blocks against all templates."""
    found = {}
    for p in re.split(r"\n[\x20\x09-\x0D]*\n", t or ""):
        for block in [*p.split("\n"), p]:
            own = set(words(block))
            for label, texts in templates.items():
                for x in texts:
                    s = set(words(x))
                    must = s if len(s) < L.SHORT else {w for w in s if w.encode() in L.NAMES or re.search("[0-9]", w)}
                    if len(s & own) >= containment * len(s) - 1e-9 and must <= own:
                        found[label] = max(found.get(label, 0), len(s & own) / len(s))
    return found


def made():
    r = random.Random(8)
    pool = [w for texts in L.TEMPLATES.values() for x in texts for w in x.split()] + ["noise", "MIT", "license", "apache", "general", "public"] * 10
    out = [x[0] for x in L.TEMPLATES.values()] + ["mit license mit license", "MIT-License", "the General\nPublic  LICENSE", "permit license", "mit licenses", "été mit license ß"]
    for _ in range(150):
        lines = [" ".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))]
        if r.random() < 0.5:
            notice = r.choice([x for t in L.TEMPLATES.values() for x in t]).split()
            lines.insert(0, " ".join(w for w in notice if r.random() < 0.9))
        out.append(r.choice(["\n", "\n\n", "\n \n"]).join(lines))
    return out


def test_scan_against_all_pairs(spark):
    texts = [*made(), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in L.scan(df).collect():
        t = texts[r.doc_id]
        w = words(t)
        places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        base, more = {x for _, x in places}, brute_labels(t, L.TEMPLATES, L.CONTAINMENT)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | more.keys()))
        assert r.score == (1.0 if places else max(more.values(), default=0.0))


def test_any_containment():
    r = random.Random(1)
    vocabulary = [(f"w{i}" if i % 7 == 0 else "w" + chr(97 + i)).encode() for i in range(40)]
    for _ in range(300):
        sets = [(f"t{i}", frozenset(r.sample(vocabulary, r.randint(1, 24)))) for i in range(6)]
        c = r.choice([0.3, 0.5, 0.8, 1.0])
        index = L.Index(sets, collections.Counter({w: r.randint(0, 9) for w in vocabulary}), c)
        block = set(r.sample(vocabulary, r.randint(0, 40)))
        want = {t: len(s & block) / len(s) for t, s in sets if len(s & block) >= c * len(s) - 1e-9 and L.required(s) <= block}
        assert index.match(block) == want and (not want or index.may_match(block))


def test_cases(spark):
    rows = cases.rows()
    got = L.scan(cases.documents(spark)).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=repr) == sorted(((r[0], len(words(r[1]))) for r in rows), key=repr)
    assert L.scan(cases.empty(spark)).count() == 0


def test_other_versions_and_terms_get_no_label(spark):
    gpl = L.TEMPLATES["gpl-3.0"][0]
    texts = ["Licensed under CC BY 4.0.", "The notes fall under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 1.0.", "The record was released under the license of the city.", gpl.replace("version 3", "version 2"), L.TEMPLATES["apache-2.0"][0].replace("2.0", "1.1")]
    right = ["Licensed under CC BY-NC 4.0.", gpl, gpl.replace("redistribute it", "share it"), "Released under the MIT License. Have fun.", L.TEMPLATES["apache-2.0"][0]]
    df = spark.createDataFrame(list(enumerate(texts + right)), "doc_id long, text string")
    got = [set(r.labels.split(",")) - {"", *L.PHRASES.values()} for r in sorted(L.scan(df).collect())]
    assert got == [set()] * len(texts) + [{"cc-by-nc-4.0"}, {"gpl-3.0"}, {"gpl-3.0"}, {"mit-text"}, {"apache-2.0"}]

"""Documents with what operators must bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, fp string, hub string, _size string, _row string, _spans string, row string, sha string, part string, n string, k string, comp string, component_id string, v string"
EXTRA = SCHEMA.count(",") - 4  # clashing columns


def texts(seed=1, n=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "été", "中文", "MIT", "license", "!!", "***"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]
    near = [made[0] + " more", made[1].replace("w1", "w2", 1)]
    long = " ".join(r.choice(words) for _ in range(40_000))
    return [*made, *near, made[2], made[2], made[3], "", "", None, " \n\t ", "x", "a" * 50_000, long]


def rows(seed=1, n=40):
    found = [(i, t, "en", ["s1", "s2", "é", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]
    found += [found[5], found[5], (None, "no id " * 30, None, None, None), (None, None, None, None, None)]
    return [(*x, *["clash"] * EXTRA) for x in found]


def documents(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

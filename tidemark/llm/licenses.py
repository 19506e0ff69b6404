"""License scans (operator 4): an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines up to the next blank one). Words are lower-cased runs of letters, digits and
non-ASCII characters. A template is found in a block that has at least CONTAINMENT of the template's distinct words, and
among them all its NAMES and numbers, which tell licenses and their versions apart; of a template below SHORT words the
block has every word.

The join is exact. The words of all templates are put in order of the number of documents that have them, counted over
the whole corpus, rarest first. A block that reaches the threshold has one of the first |T| - ceil(c|T|) + 1 words of the
template (prefix filter), at least ceil(c|T|) template words at all (length filter), and enough of them left from the
first prefix word on (positional filter); what passes is verified. A template that is demanded whole has a prefix of one
word. The templates are a parameter of bounded size and go to
every task; documents are scanned twice and never shuffled. Before the blocks of a document are looked at, its whole
word set must meet some prefix, which few do.

Base labels come from phrases whose words stand consecutively; they are always kept. The score is 1 with a base phrase,
else the largest share of a template that a block holds, else 0.

Defined cases: a null text is empty; a text without words has no labels and score 0. Repeated rows are scanned each on
its own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes

CONTAINMENT, SHORT = 0.8, 16
# fixed values: phrases and labels of the base rules
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: notices as their licenses word them
TEMPLATES = {
    "mit-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# fixed values: words that name a license or its terms
NAMES = frozenset(b"mit apache gnu mozilla creative commons cc by nc sa nd bsd unencumbered".split())
_KEEP = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_TABLE = bytes(c if _KEEP.match(bytes([c])) else 32 for c in range(256)).lower()
_BLANK = re.compile(rb"\n[\x20\x09-\x0D]*\n")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def template_sets(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(t.encode()))) for label, texts in templates.items() for t in texts]


def blocks(raw: bytes) -> Iterator[bytes]:
    """Every line, and every paragraph of several."""
    for paragraph in _BLANK.split(raw):
        lines = [x for x in paragraph.split(b"\n") if x]
        yield from lines
        if len(lines) > 1:
            yield paragraph


def required(template: frozenset[bytes]) -> frozenset[bytes]:
    """The words of a template that a block must have."""
    return template if len(template) < SHORT else frozenset(w for w in template if w in NAMES or any(48 <= c < 58 for c in w))


class Index:
    """Templates by the rare words that a block must share with them."""

    def __init__(self, sets: list[tuple[str, frozenset[bytes]]], frequency: dict[bytes, int], containment: float = CONTAINMENT):
        vocabulary = sorted(frozenset().union(*(s for _, s in sets)), key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.sets, self.prefixes = sets, {}
        self.needed = [required(s) for _, s in sets]
        self.least = [max(math.ceil(containment * len(s) - 1e-9), len(s) if r == s else 0) for (_, s), r in zip(sets, self.needed, strict=True)]
        for t, (_, s) in enumerate(sets):
            for place, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.least[t] + 1]):
                self.prefixes.setdefault(w, []).append((t, place))

    def may_match(self, words: set[bytes]) -> bool:
        return not self.prefixes.keys().isdisjoint(words)

    def match(self, block: set[bytes]) -> dict[str, float]:
        """label -> share of its best template that the block holds, where it reaches the threshold."""
        known = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        found: dict[str, float] = {}
        tried = set()
        for i, w in enumerate(known):
            for t, place in self.prefixes.get(w, ()):
                label, s = self.sets[t]
                # the first word they share: what may follow is bounded by either side
                if t in tried or len(known) < self.least[t] or min(len(s) - place, len(known) - i) < self.least[t]:
                    continue
                tried.add(t)
                if self.needed[t] <= block and (n := len(s & block)) >= self.least[t]:
                    found[label] = max(found.get(label, 0), n / len(s))
        return found


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for t in as_bytes(b, "text"):
                n.update(vocabulary.intersection(words_of(t or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").sum("n").collect()
    return {bytes(r[0]): r[1] for r in rows}


def phrase_places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every phrase whose words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        sought, at, n, upto = f" {phrase} ".encode(), -1, 0, 0
        while (at := line.find(sought, at + 1)) >= 0:
            n += line.count(b" ", upto, at)
            upto = at
            found.append((n, label))
    return found


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document. Other columns are
    ignored; null texts are empty."""
    sets = template_sets(templates)
    frequency = word_frequency(docs, frozenset().union(*(s for _, s in sets)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def one(raw: bytes, index: Index) -> tuple:
        words = words_of(raw)
        places = phrase_places(words)
        base, found = {label for _, label in places}, {}
        if index.may_match(set(words)):
            for block in blocks(raw):
                for label, share in index.match(set(words_of(block))).items():
                    found[label] = max(found.get(label, 0), share)
        starts = [p for p, _ in places]
        score = 1.0 if places else max(found.values(), default=0.0)
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sets, frequency, containment)
        for b in batches:
            columns = list(zip(*(one(t or b"", index) for t in as_bytes(b, "text")), strict=True)) or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, shape.values(), strict=True))], ["doc_id", *shape])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan over all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Packing by concatenate and cut (operator 5).

Pass one tokenizes each document once, appends the end id, and writes the ids with the task's partition number and the
number of ids before the document in that partition. The totals of the partitions, a row each, give by a prefix sum the
place of every partition in one long row of ids. Pass two adds that to a document's own offset and cuts at the
multiples of LENGTH: a document that crosses a boundary leaves a record on either side. Sequences are full but for the
last, so nothing else is padded.

Tokens do not cross ASCII white space, so a document's ids are those of its chunks between white space, which are kept
in a bounded cache of the worker; those of plain letters skip the vocabulary's normalization, which leaves them as they
are. Ids are written as 16-bit numbers if the vocabulary allows, else 32-bit.

Defined cases: a null or empty text has only the end id. Repeated rows are packed each on its own. A text of any length
is cut like any other. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, written

LENGTH = 2048
END = 1
#: Chunks that a worker's cache holds at most, and the bytes of the longest.
CACHED, LONGEST = 600_000, 48
#: Marks at a chunk's end that the vocabulary's rules always part from letters.
MARKS = ".,;:!?|*&#$%"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str) -> tuple[Callable[[bytes | None], bytes], str]:
    """A function from a text to its ids as bytes, and the type code of the ids. Both are kept by the worker process."""
    kept = sys.modules.setdefault("_tidemark_tokens", types.ModuleType("_tidemark_tokens"))
    if path in kept.__dict__:
        return kept.__dict__[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to tasks
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    code = "H" if tok.get_vocab_size() <= 1 << 16 and END < 1 << 16 else "I"
    cache: dict[bytes, bytes] = {}
    end = array(code, [END]).tobytes()

    def learn(by: Tokenizer, chunks: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in chunks]
        for w, e in zip(chunks, by.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            cache[w] = array(code, e.ids).tobytes()

    def is_plain(w: str) -> bool:
        """Lower-case Latin letters in composed form: no normalization changes them, and they are one word."""
        return w.isalpha() and max(w) < "\u0250" and w == w.lower() and unicodedata.is_normalized("NFC", w)

    def encode(text: bytes | None) -> bytes:
        if not text:
            return end
        # letters are lower-cased anyway; only the strings of special tokens must be seen as they are
        special = b"<|" in text
        words = (text if special else text.lower()).split()
        missing = set(words).difference(cache)
        if missing:
            if len(cache) > CACHED:
                cache.clear()
                missing = set(words)
            plain, other, joined = set(), [], []
            for w in missing:
                whole = w.decode("utf-8", "replace")
                core = whole.rstrip(MARKS)
                if special or not core or not is_plain(core):
                    other.append(w)
                    continue
                at = len(w) - len(whole) + len(core)  # marks are a byte each
                plain.add(w[:at])
                if at < len(w):  # a word ends where marks begin, and they are one word
                    joined.append((w, w[:at], w[at:]))
            learn(bare, [x for x in plain if x not in cache])
            learn(tok, [*other, *(x for x in {m for _, _, m in joined} if x not in cache)])
            for w, core, marks in joined:
                cache[w] = cache[core] + cache[marks]
        ids = b"".join(map(cache.__getitem__, words)) + end
        for w in missing:
            if len(w) > LONGEST:
                del cache[w]
        return ids

    kept.__dict__[path] = encode, code
    return kept.__dict__[path]


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, before, n, doc_id, ids: a document's ids, and how many stand before it in its partition."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, code = _encoder(path)
        part, before, width = TaskContext.get().partitionId(), 0, array(code).itemsize
        for b in batches:
            texts = as_bytes(b, "text")
            for at in range(0, len(texts), 256):
                ids = [encode(t) for t in texts[at : at + 256]]
                n = np.array([len(x) // width for x in ids], np.int64)
                place = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(place), pa.array(n), b.column(0).slice(at, 256), pa.array(ids, pa.binary())], ["part", "before", "n", "doc_id", "ids"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(each, f"part int, before long, n long, doc_id {kind}, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary()
    tokens = written(tokenized(docs, path, doc_id, text), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    upto = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written first, so that its size is known: Spark broadcasts it only below its own threshold
    bases = written(totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base")), "bases")
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, code = _encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            of, rows = [], []
            for i, (place, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                ids = memoryview(np.frombuffer(raw, code).astype("<u4").tobytes())
                n, start = len(ids) // 4, 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(length - offset, n - start)
                    of.append(i)
                    rows.append((start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset))
                    start += size
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names)

    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("place"), "ids")
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

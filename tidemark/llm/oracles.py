"""SQL for DuckDB that says what queries return, where SQL can.

It can't say n-gram hashes and fingerprints (no CRC-32 or XXH64 in SQL), tokenizer ids, suffix orders, the multipliers
of the mix or look-behind in patterns; those queries are tested against brute force.
"""

from __future__ import annotations

from .licenses import CONTAINMENT, PHRASES, TEMPLATES, required, words_of
from .warc import LEAST

# --- chat: the formatted length follows from the template

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_TEXT, _ROLE = _ESCAPED.format("text"), rf"replace(replace({_ESCAPED.format('role')}, '\', '\\'), chr(10), '\n')"
_SAID = "<|im_end|><|im_start|>assistant ok"
CHAT = rf"""
SELECT conv_id, count(*) AS n_turns,
    sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length({_ROLE}) + length({_TEXT}) + {len("<|im_start|>") + len("<|im_end|>") + 2}) AS BIGINT) AS formatted_chars
FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'
) GROUP BY conv_id"""

# --- licenses


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLACES = " || ".join(
    f"list_transform(list_filter(range(len(w) - {len(p.split()) - 1}), lambda i: w[i + 1 : i + {len(p.split())}] = {_list(p.split())}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES.items()
)
_SETS = [(label, frozenset(words_of(t.encode()))) for label, texts in TEMPLATES.items() for t in texts]
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(x.decode() for x in s))}, CAST({_list(sorted(x.decode() for x in required(s)))} AS VARCHAR[]))" for label, s in _SETS)
LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, doc_id, w, {_PLACES} AS places FROM (SELECT r, doc_id, {_WORDS.format("text")} AS w FROM d)),
paragraphs AS (SELECT r, unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) AS block FROM d),
blocks AS (SELECT r, block FROM paragraphs UNION ALL SELECT r, unnest(string_split(block, chr(10))) FROM paragraphs),
sets AS (SELECT r, list_distinct({_WORDS.format("block")}) AS own FROM blocks),
t(label, t, needed) AS (VALUES {_TEMPLATES}),
hits AS (SELECT r, label, len(list_intersect(own, t)) / len(t) AS share FROM sets, t WHERE len(list_intersect(own, t)) >= {CONTAINMENT} * len(t) - 1e-9 AND len(list_intersect(own, needed)) = len(needed)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
    CAST(list_min(list_transform(places, lambda x: x.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(places, lambda x: x.at)) AS BIGINT) AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label) || coalesce(labels, []))), ',') AS labels,
    CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN found USING (r)"""

# --- archives

_BITS = "list_aggregate(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(sha, i + 1, 1)) - 1) + 1, 4)), 'string_agg', '')"
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), 'string_agg', '')"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, 'urn:x-page:' || coalesce(page_id::VARCHAR, 'None')) AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, {_BITS} AS bits, payload_bytes >= {LEAST} AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM q)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to, url FROM b"""

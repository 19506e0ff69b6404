r"""Personal data (operator 9), in DataFrame functions only.

Regular expressions propose spans. Validators confirm them: the parts of an address at most 255, Luhn's sum of a card,
mod-97 of an IBAN, which has the length its country has fixed, the digits of a phone number. Words near a span adjust its score. Base kinds (email, ip, card,
phone) stay once confirmed, whatever their score; iban is confirmed by mod-97; ssn needs a word nearby that speaks for
it, as its pattern alone proves little.

The patterns are those of the base rules, rewritten so that no text makes them slow: a run is entered only at its
start, or where the match before ended (\G), and never given back (possessive), which finds the same matches. Positions
come from the lengths of what lies between matches, in code points, summed in blocks so that a text of many matches takes
little more time than its length; matches are confirmed before anything is built for them. No row leaves the JVM and
nothing is shuffled.

The context of a span ends at the next match of its pattern.

Defined cases: null and empty texts have no spans. Repeated rows are scanned each on its own. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{{1,2}})"
#: Characters of an IBAN by country: the registry, and the countries that use them without an entry.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(rf"(?:{of.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, of in _IBAN.items())
#: Kinds in the order in which ties are listed, with their patterns.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_COUNTRIES})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must have for a pattern to be tried at all.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Words within CONTEXT characters before or after a span that raise its score.
WORDS = {
    "email": "e-?mail|contact|write|address",
    "ip": r"\bip\b|address|server|host|client",
    "card": "card|visa|master|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
    "ssn": r"\bssn\b|social security|tax ?id",
}
CONTEXT, CONFIRMED, PATTERN_ONLY, NEARBY, LEAST = 40, 0.7, 0.3, 0.3, 0.5

_LUHN = """length(regexp_replace({v}, '[ -]', '')) BETWEEN 14 AND 19 AND aggregate(
    split(reverse(regexp_replace({v}, '[ -]', '')), ''), struct(0 AS i, 0 AS s),
    (a, d) -> struct(a.i + 1 AS i, a.s + CASE WHEN a.i % 2 = 0 THEN int(d) WHEN d >= '5' THEN 2 * int(d) - 9 ELSE 2 * int(d) END AS s),
    a -> a.s % 10 = 0)"""
_MOD97 = """aggregate(split(concat(substring(replace({v}, ' ', ''), 5), substring(replace({v}, ' ', ''), 1, 4)), ''), 0L,
    (a, c) -> CASE WHEN c <= '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""
CONFIRM = {
    "email": "true",
    "ip": "{v} RLIKE r'^" + f"{_BYTE}(?:[.]{_BYTE})" + "{{3}}$'",
    "card": _LUHN,
    "phone": "length(regexp_replace({v}, '[^0-9]', '')) BETWEEN 10 AND 15",
    "iban": _MOD97,
    "ssn": "true",
}


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs and _spans: array of (s, o, e, kind, v, score), by start and then kind."""
    hits = {f"_h_{k}": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    hits = {n: F.when(F.contains(F.col(text), F.lit(_NEEDS[n[3:]])), h) if n[3:] in _NEEDS else h for n, h in hits.items()}
    docs = docs.withColumns(hits)
    docs = docs.withColumns({f"_g_{k}": F.when(F.size(f"_h_{k}") > 0, F.split(F.col(text), p, -1)) for k, p in PATTERNS.items()})
    docs = docs.withColumns({f"_p_{k}": F.expr(f"CASE WHEN size(_h_{k}) > 0 THEN {_before(k)} END") for k in PATTERNS})
    found = []
    for o, kind in enumerate(PATTERNS):
        h, g = f"_h_{kind}", f"_g_{kind}"
        start = f"_p_{kind}[i] + length({g}[i])"
        near = f"lower(concat(right({g}[i], {CONTEXT}), '\\n', left({g}[i + 1], {CONTEXT}))) RLIKE r'{WORDS[kind]}'"
        score = f"{PATTERN_ONLY if kind == 'ssn' else CONFIRMED}D + CASE WHEN {near} THEN {NEARBY}D ELSE 0D END"
        span = f"struct({start} AS s, {o} AS o, {start} + length({h}[i]) AS e, '{kind}' AS kind, {h}[i] AS v, {score} AS score)"
        kept = f"transform(filter(sequence(0, size({h}) - 1), i -> {CONFIRM[kind].format(v=f'{h}[i]')}), i -> {span})"
        found.append(f"CASE WHEN size({h}) > 0 THEN {kept if kind in BASE else f'filter({kept}, x -> x.score >= {LEAST}D)'} ELSE array() END")
    return docs.withColumn("_spans", F.expr(f"array_sort(concat({', '.join(found)}))")).drop(*hits, *(f"_{c}_{k}" for c in "gp" for k in PATTERNS))


def _before(kind: str) -> str:
    """SQL: for each match, the characters before the gap that it follows. Sums go over blocks first, and within each block
    from the sum of those before, as adding to an array takes as long as it is."""
    h, n = f"_h_{kind}", f"size(_h_{kind})"
    block = f"(int(ceil(cbrt(2 * {n}))) + 1)"
    own = f"length(_g_{kind}[i]) + length({h}[i])"
    row = lambda b: f"sequence({b} * {block}, least({n}, ({b} + 1) * {block}) - 1)"
    empty = "array() :: array<int>"
    sums = f"""aggregate(sequence(0, ({n} - 1) div {block}), struct(0 AS p, {empty} AS out), (a, c) ->
        struct(a.p + aggregate({row("int(c)")}, 0, (t, i) -> t + {own}) AS p, array_append(a.out, a.p) AS out), a -> a.out)"""
    return f"""flatten(transform({sums}, (p, b) -> aggregate({row("b")}, struct(p AS p, {empty} AS out), (a, i) ->
        struct(a.p + {own} AS p, array_append(a.out, a.p) AS out), a -> a.out)))"""


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, end, kind, value, score) by start; code points, end exclusive."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _with_spans(own, "text").select("doc_id", F.expr("transform(_spans, x -> struct(x.s AS start, x.e AS end, x.kind AS kind, x.v AS value, x.score AS score))").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with [KIND] in the place of each span; of spans that overlap, the first gives the name. n_chars follows."""
    cut = f"""aggregate(_spans, struct(0 AS p, array() :: array<string> AS out), (a, x) -> CASE
        WHEN x.s >= a.p THEN struct(x.e AS p, concat(a.out, array(substring(text, a.p + 1, x.s - a.p), concat('[', upper(x.kind), ']'))) AS out)
        ELSE struct(greatest(a.p, x.e) AS p, a.out AS out) END, a -> concat(array_join(a.out, ''), substring(text, a.p + 1)))"""
    own = _with_spans(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text")), "text")
    own = own.withColumn("_new", F.expr(f"CASE WHEN size(_spans) > 0 THEN {cut} ELSE text END"))
    new = {text: F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return own.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base spans of every document, all its spans and the best score among them."""
    spans = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = f"filter(spans, x -> x.kind IN {BASE})"
    counts = [F.expr(f"bigint(size(filter(spans, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(F.expr(said.format(base)), 256).alias("base_sha256"), F.expr(said.format("spans")).alias("spans"), F.expr("array_max(transform(spans, x -> x.score))").alias("best_score"))

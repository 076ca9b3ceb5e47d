"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust their score.

Spans of the base kinds stay whatever their score; those of the added kinds are dropped under LEAST_ADDED. An IBAN has a
checksum and passes alone; a secret (a long hexadecimal run) has none and needs a context word, else it may be any digest.

All patterns are written so that a scan is linear in the text: a run that can't match is passed over once, by possessive
quantifiers and by starting only where a run of the pattern's characters starts; an IBAN's run is bounded instead.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm.common import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
#: Score in hundredths of a confirmed span without, and what a context word before it adds.
SCORES = {"email": 90, "ip": 50, "card": 80, "phone": 60, "iban": 90, "secret": 40}
CONTEXT_ADDS, CONTEXT_CHARS = 10, 48
#: Least score of a span of an added kind.
LEAST_ADDED = 50
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "credit", "debit", "visa", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "credential", "api_key", "apikey", "access_key", "auth_token", "access_token"),
}
#: A context word, in a window that begins one character before its first place.
NEAR = {k: r"(?i)[^A-Za-z0-9_](?:" + "|".join(v) + r")(?:[^A-Za-z0-9_]|$)" for k, v in CONTEXT.items()}
_NEAR = {k: re.compile(v, re.A) for k, v in NEAR.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])")
#: Characters of an IBAN by its country, as registered.
_IBAN_CHARS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an IBAN without spaces: the first four characters go to the end, letters count from 10, remainder 1."""
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping matches, found from each @: the run of local characters before it, then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ibans(text: str):
    """Spans whose mod 97 holds: of a run, which may go on into words and numbers behind, the country's length, else all of it."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        places = [k for k in range(start, end) if text[k] != " "]
        n = _IBAN_CHARS.get(text[start : start + 2], len(places))
        own = places[n - 1] + 1 if n <= len(places) else end
        for e in (own, end):
            if (e == end or text[e] == " ") and mod97(text[start:e].replace(" ", "")):
                yield start, e
                at = e
                break


def score(kind: str, text: str, start: int) -> int:
    """Hundredths for a span of a kind that starts there: more if a context word ends within CONTEXT_CHARS before it."""
    window = text[max(0, start - CONTEXT_CHARS - 1) : start]
    near = _NEAR[kind].search(window if start > CONTEXT_CHARS else " " + window)
    return SCORES[kind] + CONTEXT_ADDS * (near is not None)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every confirmed span, by kind as listed in KINDS, then by start. Code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
        out += [("iban", a, b) for a, b in _ibans(text)]
        out += [("secret", *m.span()) for m in _SECRET.finditer(text) if not m.group().isdigit() and not m.group().isalpha()]
    scored = [(k, a, b, score(k, text, a)) for k, a, b in out]
    return [(k, a, b, s / 100) for k, a, b, s in scored if k in BASE or s >= LEAST_ADDED]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scan(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] if t else [] for t in (x.as_py() for x in texts)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) for every row of docs(doc_id, text): one pass, nothing is shuffled.

    A null text is empty and has no spans; rows that repeat an id get a row each; other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, schema)


def redact(text: str) -> str:
    """The text with every confirmed span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, last = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
            last = b
    return "".join([*out, text[last:]])


def _of(kind: str):
    return lambda span: span["kind"] == kind


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document, and their scores in hundredths, in the order of the spans."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"), scores.alias("scores"))


def _matches(kind: str, order: int, pattern: str, given: str, text: str = "t") -> str:
    """SQL for the matches of a pattern with their places, from what it splits the text into. given: texts that may have any."""
    ahead = "coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)"
    return f"""
  SELECT rid, '{kind}' AS kind, {order} AS o, m[k] AS x, ({ahead})::BIGINT AS a, regexp_replace(m[k], '[^0-9]', '', 'g') AS digits,
         substr(' ' || t, greatest(a - {CONTEXT_CHARS - 1}, 1), least(a, {CONTEXT_CHARS}) + 1) AS ahead
  FROM (SELECT rid, t, m, p, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT rid, t, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS p FROM d WHERE {given}))"""


_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INTEGER ELSE 2 * digits[i]::INTEGER - CASE WHEN digits[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = "list_reduce(list_concat([0], list_transform(string_split(substr(c, 5) || c[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x::INTEGER ELSE ascii(x) - 55 END)), lambda r, v: CASE WHEN v > 9 THEN (r * 100 + v) % 97 ELSE (r * 10 + v) % 97 END) = 1"
#: An underscore is an edge, as other signs are; places stay.
_EDGES = "translate(t, '_', '.')"
_POINTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {SCORES[k]} + CASE WHEN regexp_matches(ahead, '{NEAR[k]}') THEN {CONTEXT_ADDS} ELSE 0 END" for k in KINDS) + " END"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(
    [
        _matches("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "contains(t, '@')"),
        _matches("ip", 2, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "regexp_matches(t, '[0-9]\\.[0-9]')"),
        _matches("card", 3, r"[0-9](?:[\x20-]?[0-9])+", "regexp_matches(t, '[0-9]')"),
        _matches("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')"),
        _matches("iban", 5, r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "regexp_matches(t, '[A-Z]{2}[0-9]{2}')", _EDGES),
        _matches("secret", 6, r"\b[0-9A-Fa-f]{32,64}\b", "regexp_matches(t, '[0-9A-Fa-f]{32}')", _EDGES),
    ]
)}),
spans AS (
  SELECT rid, kind, o, a, kind || ':' || a || ':' || (a + length(x)) AS s, {_POINTS} AS score
  FROM (SELECT *, replace(x, ' ', '') AS c FROM proposed)
  WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST(ltrim(y, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND {_LUHN}
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN {_MOD97}
    WHEN 'secret' THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Fa-f]')
    ELSE true END AND (o < 5 OR score >= {LEAST_ADDED})),
found AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
         count(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(s, ',' ORDER BY o, a) FILTER (WHERE o < 5) AS base, string_agg(s, ',' ORDER BY o, a) AS spans,
         string_agg(score, ',' ORDER BY o, a) AS scores
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN found USING (rid)
"""

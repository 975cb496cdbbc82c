"""Personal data: regular expressions propose spans, checksums confirm them, and nearby words adjust their scores.

Base kinds, leftmost and non-overlapping for each kind, failing matches dropped without another try: email, ip (parts at
most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15 digits). The method adds the kind iban (mod-97, of the
country code's own length where that is known). Every kind has a base score; a context word of the kind within
``CONTEXT`` code points before the span, or ``CONTEXT`` // 2 behind it, raises it, and one that speaks of something else lowers it.

Edge cases: null text is empty text and has no span. Whole texts are searched, in time that grows with their length. Repeated
rows are judged alone. An empty table gives an empty result.
Other columns pass through, except that result columns replace columns of the same name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

# The kinds in their order, and their patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, found without trying each digit of a long number as a start.
IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", re.ASCII)
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
#: Scores in thousandths: of each kind, for a word that speaks for it, and for one that speaks against it.
BASE_SCORE = {"email": 900, "ip": 600, "card": 800, "phone": 700, "iban": 900}
GOOD, BAD = 100, 300
CONTEXT = 40
# Words that speak for a kind, and words that speak against it.
FOR = {
    "email": ("mail", "contact", "write to", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
}
AGAINST = {"email": ("example",), "ip": ("version", "release", "section"), "card": ("order", "tracking", "serial", "isbn"), "phone": ("isbn", "serial", "score"), "iban": ("serial", "part no")}
WORDS = {k: [re.compile(r"\b(?:" + "|".join(w[k]) + r")\b", re.ASCII) for w in (FOR, AGAINST)] for k in KINDS}
#: Lengths of national account numbers, for the most common countries.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25, "SE": 24}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


#: Letters as the numbers from 10 on that mod-97 takes them for.
NUMBERS = {ord("A") + i: str(10 + i) for i in range(26)}


def mod97(iban: str) -> bool:
    return int((iban[4:] + iban[:4]).translate(NUMBERS)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """A match begins where the run of local characters before an @ does, or the last match ended; the domain is tried once."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        a = free + len(local.rstrip(LOCAL))
        free = at + 1  # nothing before this @ can be of a later match
        if a < at and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
            free = m.end()
        at = text.find("@", free)


def ips(text: str):
    for m in IP_RUN.finditer(text) if text.count(".") >= 3 else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    """Of each match the prefix, cut at a group's end, that mod-97 confirms: of the country's length, or else the longest.

    The search goes on behind the prefix, or behind the country code where none is confirmed.
    """
    at = 0
    while m := IBAN.search(text, at):
        n = IBAN_LENGTHS.get(m[0][:2])
        at = m.start() + 2
        for end in (e for e in range(m.end(), m.start(), -1) if e == m.end() or text[e] == " "):
            s = text[m.start() : end].replace(" ", "")
            if (15 <= len(s) if n is None else len(s) == n) and mod97(s):
                yield m.start(), end
                at = end
                break


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones, ibans)))


def adjusted(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT // 2]).lower()
    good, bad = WORDS[kind]
    return min(1000, max(0, BASE_SCORE[kind] + GOOD * bool(good.search(near)) - BAD * bool(bad.search(near)))) / 1000


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind and start; code points, the end exclusive."""
    return [(k, a, b, adjusted(text, k, a, b)) for k in KINDS for a, b in FINDERS[k](text)] if text else []


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def redacted(text: str, spans: list[tuple[str, int, int, float]], least: float) -> str:
    """``text`` with each span of at least that score replaced by its kind in brackets; of overlapping spans the first, then the longest."""
    out, at = [], 0
    for k, a, b, score in sorted(spans, key=lambda s: (s[1], -s[2])):
        if score >= least and a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text", redact_at: float | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with pii, the array of spans with their scores; and, with ``redact_at``, redacted_text, free of spans of that score."""
    fields = [T.StructField("pii", SPANS), *([] if redact_at is None else [T.StructField("redacted_text", T.StringType())])]

    def make():
        def work(col: pa.Array) -> list[pa.Array]:
            texts = col.to_pylist()
            found = [find_spans(t) for t in texts]
            out = [pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found], ARROW_SPANS)]
            if redact_at is not None:
                out.append(pa.array([t and redacted(t, x, redact_at) for t, x in zip(texts, found)], pa.string()))
            return out

        return work

    return annotate(docs, [text_col], make, fields, drop)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = {f"n_{k}": F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)") for k in BASE_KINDS}
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return out.select("doc_id", *(c.alias(n) for n, c in count.items()), F.sha2(F.encode(joined(base), "utf-8"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))


def oracle_op5() -> str:
    """SQL of the query: matches of each pattern, their places from the pieces between them, then the same confirmations and scores."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}
    found = " UNION ALL ".join(
        f"SELECT r, t, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p.pattern}') AS ms, string_split_regex(t, '{p.pattern}') AS ps FROM d" for i, (k, p) in enumerate(patterns.items())
    )
    lengths = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items())
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INT) ELSE 2 * CAST(g[i] AS INT) - 9 * CAST(CAST(g[i] AS INT) > 4 AS INT) END))"
    letters = "array_to_string(list_transform(string_split(s[5:] || s[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod = f"list_reduce(list_transform(string_split({letters}, ''), lambda c: CAST(c AS INT)), lambda a, b: (10 * a + b) % 97)"
    base = " ".join(f"WHEN '{k}' THEN {v}" for k, v in BASE_SCORE.items())
    good, bad = (" ".join(f"WHEN '{k}' THEN CAST(regexp_matches(near, '\\b(?:{'|'.join(w[k])})\\b') AS INT)" for k in KINDS) for w in (FOR, AGAINST))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
x AS (SELECT r, t, kind, o, u.i AS i, ms[u.i] AS m, CAST(list_sum(list_transform(ps[1 : u.i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1 : u.i - 1], lambda p: length(p))), 0) AS BIGINT) AS a
  FROM f, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i) u),
y AS (SELECT *, {digits} AS g, replace(m, ' ', '') AS s, CASE substr(m, 1, 2) {lengths} END AS n FROM x),
z AS (SELECT r, t, kind, o, a, CASE WHEN kind = 'iban' AND n IS NOT NULL THEN length(regexp_extract(m, '^(?: ?[A-Z0-9]){{' || n || '}}')) ELSE length(m) END AS k, m, g, CASE WHEN n IS NULL THEN s ELSE s[:n] END AS s, n, length(s) AS w FROM y),
v AS (SELECT r, kind, o, a, a + k AS b, lower(substr(t, greatest(a - {CONTEXT}, 0) + 1, least(a, {CONTEXT})) || ' ' || substr(t, a + k + 1, {CONTEXT // 2})) AS near FROM z WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS HUGEINT) > 255)) = 0
  WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0
  WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
  ELSE (n IS NULL AND w <= 34 OR w >= n) AND {mod} = 1 AND (k = length(m) OR substr(m, CAST(k AS INT) + 1, 1) = ' ') END),
q AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) FILTER (WHERE o < {len(BASE_KINDS)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) AS spans,
  max(least(1000, greatest(0, (CASE kind {base} END) + {GOOD} * (CASE kind {good} END) - {BAD} * (CASE kind {bad} END)))) / 1000 AS top FROM v GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top, 0.0) AS max_score
FROM d LEFT JOIN q USING (r)
"""

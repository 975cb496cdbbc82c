"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text are rejected.

DataFrame expressions only. A line (split at \\n) with a word fails if
- navigation: its separators (`|`, `>`, `<`) are at least ``SEPARATORS`` of its words, and at least three;
- symbols: its symbols `[#*$%&|<>]` are at least ``SYMBOLS`` times its words, and at least three;
- boilerplate: it has one of the ``BOILERPLATE`` phrases;
- repeat: it equals an earlier line;
- punctuation: it has at least ``LONG_LINE`` words and no sentence mark at all.
The document is kept if the lines that remain have more than ``LEAST_KEPT`` of its words and if it passes the base rules
(at least 50 words, at most half of them in 3-word windows that the text repeats).

What costs most is done only where it can matter: windows are listed by place only in texts where two are equal, lines in
texts where two are equal, phrases are looked for in lines only of texts that have one, and words of a line are counted only
if a rule that needs their number may apply.

Edge cases: null text counts as empty, has no words and so fails the base rules; its cleaned text is empty. Texts are judged
whole, however long. Repeated rows are judged alone. An empty table gives an empty result. Other columns are kept; result
columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEPARATORS, SYMBOLS, LONG_LINE, LEAST_KEPT = 0.3, 0.5, 12, 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
# Phrases of boilerplate, as one alternation that both Java and RE2 read alike.
BOILERPLATE = "cookie|privacy policy|terms of use|terms of service|all rights reserved|sign in|log in|subscribe|newsletter|javascript|click here|read more|lorem ipsum|share on"

WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "n_bad_lines", "kept")


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once, and not again in each turn of an inner lambda."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def repeated_words(words: str, hashes: str) -> str:
    """How many words are in 3-word windows that occur twice or more: windows are sorted by hash, and equal neighbours cover their words."""
    covered = "aggregate(s, named_struct('c', 0L, 'e', -1), (a, i) -> named_struct('c', a.c + (i + 3 - greatest(i, a.e)), 'e', i + 3), a -> a.c)"
    twins = "sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))"
    listed = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    return f"if(size(array_distinct({hashes})) = size({hashes}), 0L, {let('s', listed, let('s', twins, covered))})"


def again(lines: str) -> str:
    """The numbers of the lines that equal an earlier one, as the keys of a map; null if no two lines are equal."""
    later = "transform(filter(s, (e, k) -> k > 0 AND get(s, k - 1).x = e.x), e -> named_struct('k', e.i, 'v', true))"
    listed = f"sort_array(transform({lines}, (x, i) -> named_struct('x', x, 'i', i)))"
    return f"if(size(array_distinct({lines})) = size({lines}), NULL, map_from_entries({let('s', listed, later)}))"


def line_verdict(line: str, repeated: str, phrased: str, symbols: str) -> str:
    """A struct of a line: its words (null where no rule needs them), whether it repeats one, and whether it fails."""
    doubtful = f"({repeated} OR p OR (y >= 3) OR NOT {line} RLIKE '[.!?;:]')"
    fails = f"n > 0 AND ({repeated} OR p OR (y >= 3 AND (y >= {SYMBOLS} * n OR regexp_count({line}, '[|<>]') >= greatest(3, {SEPARATORS} * n))) OR (n >= {LONG_LINE} AND NOT {line} RLIKE '[.!?;:]'))"
    judged = let("n", f"if({doubtful}, regexp_count({line}, {q(WORD)}), CAST(NULL AS INT))", f"named_struct('n', n, 'again', {repeated} AND n > 0, 'bad', coalesce({fails}, false))")
    own = let("y", f"if({symbols}, regexp_count({line}, '[#*$%&|<>]'), 0)", judged)
    return let("p", f"{phrased} AND {line} RLIKE '(?i)({BOILERPLATE})'", own)


def quality(docs: DataFrame, text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """``docs`` with the figures named in ``RESULTS`` and, with ``clean_col``, the text without the lines that fail."""
    gone = {x.lower() for x in (*RESULTS, *([clean_col] if clean_col else []))} - {text_col.lower()}
    df = docs.drop(*[c for c in docs.columns if c.lower() in gone])
    text = f"coalesce(`{text_col}`, '')"
    # lower() of other letters may only add matches, and each line is looked at again
    phrased = " OR ".join(f"contains(t, '{x}')" for x in BOILERPLATE.split("|"))
    df = df.withColumns({"__quality_w": F.expr(f"regexp_extract_all({text}, {q(WORD)}, 0)"), "__quality_l": F.expr(f"split({text}, '\\n', -1)"), "__quality_y": F.expr(f"CAST(regexp_count({text}, '[#*$%&|<>]') AS BIGINT)")})
    windows = "slice(transform(__quality_w, (x, i) -> xxhash64(x, get(__quality_w, i + 1), get(__quality_w, i + 2))), 1, greatest(size(__quality_w) - 2, 0))"
    df = df.withColumns({"__quality_h": F.expr(windows), "__quality_again": F.expr(again("__quality_l")), "__quality_p": F.expr(let("t", f"lower({text})", phrased))})
    verdict = line_verdict("x", "coalesce(__quality_again[i], false)", "__quality_p", "__quality_y >= 3")
    df = df.withColumn("__quality_lines", F.expr(f"transform(__quality_l, (x, i) -> {verdict})"))
    df = df.withColumns(
        {
            "n_words": F.expr("CAST(size(__quality_w) AS BIGINT)"),
            "word_chars": F.expr("CAST(length(array_join(__quality_w, '')) AS BIGINT)"),
            "n_symbols": F.col("__quality_y"),
            "n_dup_lines": F.expr("CAST(if(__quality_again IS NULL, 0, size(filter(__quality_lines, l -> l.again))) AS BIGINT)"),
            "n_repeat_words": F.expr(repeated_words("__quality_w", "__quality_h")),
            "n_kept_words": F.expr("size(__quality_w) - aggregate(filter(__quality_lines, l -> l.bad), 0L, (a, l) -> a + l.n)"),
            "n_bad_lines": F.expr("CAST(size(filter(__quality_lines, l -> l.bad)) AS BIGINT)"),
        }
    )
    if clean_col:
        df = df.withColumn(clean_col, F.expr("array_join(filter(__quality_l, (x, i) -> NOT __quality_lines[i].bad), '\\n')"))
    df = df.drop("__quality_w", "__quality_l", "__quality_y", "__quality_h", "__quality_again", "__quality_p", "__quality_lines")
    df = df.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    return df.withColumn("kept", F.expr(f"NOT base_failed AND n_kept_words > {LEAST_KEPT} * n_words"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULTS)


ORACLE_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
g AS (
  SELECT r, u.i AS i, w[u.i] AS a, w[u.i + 1] AS b, w[u.i + 2] AS c
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) u
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g) WHERE k > 1) GROUP BY r
), l AS (
  SELECT r, i, x, len(regexp_extract_all(x, '{WORD}')) AS n, len(regexp_extract_all(x, '[#*$%&|<>]')) AS y,
         len(regexp_extract_all(x, '[|<>]')) AS sep, row_number() OVER (PARTITION BY r, x ORDER BY i) > 1 AS again
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d)
), j AS (
  SELECT r, n, again AND n > 0 AS again,
         n > 0 AND (again OR regexp_matches(x, '(?i)({BOILERPLATE})')
           OR (y >= 3 AND (y >= {SYMBOLS} * n OR sep >= greatest(3, {SEPARATORS} * n)))
           OR (n >= {LONG_LINE} AND NOT regexp_matches(x, '[.!?;:]'))) AS bad
  FROM l
), jl AS (
  SELECT r, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_bad_lines, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS n_kept_words
  FROM j GROUP BY r
), o AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(n_kept_words AS BIGINT) AS n_kept_words, n_bad_lines
  FROM w LEFT JOIN rep USING (r) JOIN jl USING (r)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_kept_words > {LEAST_KEPT} * n_words AS kept
FROM o
"""

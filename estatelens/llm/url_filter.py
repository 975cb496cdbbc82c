"""URL filters: block and allow rules, and gradient-boosted trees on lexical features for URLs that no rule fits.

Everything on the path of the rows is SQL expressions: parsing, features, and the trees as CASE expressions in the logistic
sum. The trees are fitted on the driver from a bounded sample of labelled URLs (``MAX_LABELLED``). Features: length, host
length, path depth, digit ratio, entropy of the host's characters, numbers of parameters, hyphens and labels, the longest
label, and the block rate of the host's suffix among the labelled URLs. ``pages`` has no labels, so its query is trained on
the labelled URLs of ``labelled_urls``, which a rule makes.

Edge cases: a url that is null or without `://` has an empty host and path, fits no rule with a host, and is judged on what
features it has. URLs are judged whole, however long. Repeated rows are judged alone; an empty table gives an empty result.
Other columns are kept; result columns replace columns of the same name. Of rules for one host and path with different
verdicts allow holds. The number of rules and of suffixes has no limit.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, table

#: Entries that a CASE expression may have (more are looked up in a table, with the same results), and labelled rows that trees are fitted on.
MOST_CASES, MAX_LABELLED = 1000, 20_000
ROUNDS, RATE, LEAST_ROWS, BINS = 24, 0.3, 4, 32
# Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_rate")


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def labelled_urls() -> list[tuple[str, int]]:
    """URLs with label 1 (block) or 0, made by rule. Each of six signs is commoner among the former, none decides alone.

    The signs: a suffix of the cheap ones, a host of several hyphened words or a long one, digits in the host, a deep path,
    many parameters, and a long random path segment.
    """
    words = ("daily", "river", "city", "open", "green", "north", "world", "modern", "news", "garden", "library", "weather", "recipes", "museum", "school", "science")
    lures = ("win", "cheap", "free", "fast", "deal", "casino", "pills", "bets", "loan", "replica", "crypto", "bonus")
    usual, cheap = ("com", "org", "edu", "de", "fr", "net"), ("top", "xyz", "click", "loan", "win", "com")
    seen, out = 40_503, []

    def pick(n: int) -> int:
        nonlocal seen
        seen = (seen * 1_103_515_245 + 12_345) % (1 << 31)
        return (seen >> 8) % n

    for i in range(1200):
        bad = i % 2
        sign = [pick(100) < (70 if bad else 12) for _ in range(6)]
        suffix = cheap[pick(6)] if sign[0] else usual[pick(6)]
        name = "-".join(lures[pick(12)] for _ in range(2 + pick(3))) if sign[1] else words[pick(16)] + words[pick(16)] * pick(2)
        name += str(pick(9000) + 10) if sign[2] else ""
        host = f"{('', 'www.', 'm.', 'blog.')[pick(4)]}{name}.{suffix}"
        path = "".join(f"/{words[pick(16)]}" for _ in range(3 + pick(4) if sign[3] else pick(3)))
        path += f"/{pick(1 << 30):x}{pick(1 << 30)}" if sign[5] else f"/{pick(5000)}" * pick(2)
        query = "&".join(f"{words[pick(16)][:3]}={pick(900)}" for _ in range(3 + pick(4) if sign[4] else pick(2)))
        out.append((f"{'https' if pick(3) else 'http'}://{host}{path}{'?' + query if query else ''}", bad))
    return out


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(LOWER[ord(c) - 65] if "A" <= c <= "Z" else c for c in host), rest[:end], rest[end:]


def features_of(url: str | None, rates: dict[str, float], prior: float) -> list[float]:
    """The features in plain Python, for labelled rows on the driver; ``feature_sql`` says the same."""
    host, path, rest = parts(url)
    url = url or ""
    labels = host.split(".") if host else []
    p = [host.count(c) / len(host) for c in dict.fromkeys(host)]
    return [
        float(len(url)), float(len(host)), float(path.count("/")), sum("0" <= c <= "9" for c in url) / max(1, len(url)), -sum(x * math.log2(x) for x in p) if p else 0.0,
        float(rest.count("=")), float(host.count("-")), float(len(labels)), float(max(map(len, labels), default=0)), rates.get(labels[-1] if labels else "", prior),
    ]


def count_sql(x: str, c: str) -> str:
    return f"(length({x}) - length(replace({x}, '{c}', '')))"


def feature_sql(rates: dict[str, float], prior: float, dialect: str = "spark") -> dict[str, str]:
    """The features as SQL over columns u (the url, '' for null), host, path and rest."""
    digits = "(length(u) - length(translate(u, '0123456789', '')))"
    if dialect == "spark":
        labels = "filter(split(host, '[.]', -1), x -> host <> '')"
        entropy = f"aggregate(transform(array_distinct(split(host, '')), c -> {count_sql('host', '@').replace(chr(39) + '@' + chr(39), 'c')} / length(host)), 0D, (a, p) -> a - p * log2(p))"
        n_labels, longest, suffix = f"size({labels})", f"coalesce(array_max(transform({labels}, x -> length(x))), 0)", "substring_index(host, '.', -1)"
    else:
        labels = "list_filter(string_split(host, '.'), lambda x: host <> '')"
        entropy = "-list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: (length(host) - length(replace(host, c, ''))) / length(host) * log2((length(host) - length(replace(host, c, ''))) / length(host))))"
        n_labels, longest, suffix = f"len({labels})", f"coalesce(list_max(list_transform({labels}, lambda x: length(x))), 0)", "regexp_extract(host, '[^.]*$')"
    cases = " ".join(f"WHEN {quoted(k)} THEN {number(v)}" for k, v in sorted(rates.items()))
    rate = f"CASE {suffix} {cases} ELSE {number(prior)} END" if rates else number(prior)
    if dialect == "spark" and len(rates) > MOST_CASES:
        rate = f"coalesce(__url_rate, {number(prior)})"
    exprs = ("length(u)", "length(host)", count_sql("path", "/"), f"{digits} / greatest(1, length(u))", f"CASE WHEN host = '' THEN 0 ELSE {entropy} END", count_sql("rest", "="), count_sql("host", "-"), n_labels, longest, rate)
    return {k: f"CAST({e} AS DOUBLE)" for k, e in zip(FEATURES, exprs)}


def number(v: float) -> str:
    """A literal that is a double in Spark and elsewhere, not a decimal."""
    return repr(v) if "e" in repr(v) else f"{v!r}E0"


class Trees:
    """Depth-two trees of a logistic boosting, each three (feature, threshold) cuts and four leaf values."""

    def __init__(self, bias: float, trees: list[tuple], rates: dict[str, float], prior: float):
        self.bias, self.trees, self.rates, self.prior = bias, trees, rates, prior

    def margin(self, row: list[float]) -> float:
        return self.bias + sum(leaf[2 * (row[f] > t) + (row[g] > s)] if row[f] <= t else leaf[2 + (row[h] > r)] for (f, t), (g, s), (h, r), leaf in self.trees)

    def sql(self) -> str:
        """The margin as SQL over the features' names."""

        def cut(c):
            return f"{FEATURES[c[0]]} <= {number(c[1])}"

        return " + ".join([f"({number(self.bias)})"] + [f"CASE WHEN {cut(a)} THEN CASE WHEN {cut(b)} THEN {v[0]} ELSE {v[1]} END ELSE CASE WHEN {cut(c)} THEN {v[2]} ELSE {v[3]} END END" for a, b, c, leaf in self.trees for v in [list(map(number, leaf))]])


def best_cut(rows: list[list[float]], idx: list[int], grad: list[float], hess: list[float]) -> tuple[int, float]:
    """The (feature, threshold) with the most gain; thresholds lie midway between neighbouring values, at most BINS of them."""
    total_g, total_h = sum(grad[i] for i in idx), sum(hess[i] for i in idx)
    best = (0, math.inf, 1e-9)
    for f in range(len(FEATURES)):
        order = sorted(idx, key=lambda i: rows[i][f])
        values = sorted({rows[i][f] for i in idx})
        step = max(1, len(values) // BINS)
        cuts = {values[k]: (values[k] + values[k + 1]) / 2 for k in range(0, len(values) - 1, step)}
        g = h = 0.0
        for k, i in enumerate(order):
            g, h = g + grad[i], h + hess[i]
            x = rows[i][f]
            if k + 1 >= LEAST_ROWS and len(order) - k - 1 >= LEAST_ROWS and rows[order[k + 1]][f] != x and x in cuts:
                gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                if gain > best[2]:
                    best = (f, cuts[x], gain)
    return best[:2]


def fit(labelled: list[tuple[str | None, int]]) -> Trees:
    """Boosted trees from labelled urls; with one class only, no trees and that class's bias."""
    labelled = sorted((u or "", int(y)) for u, y in labelled)
    n, ones = len(labelled), sum(y for _, y in labelled)
    prior = (ones + 1) / (n + 2)
    by: dict[str, list[int]] = {}
    for u, y in labelled:
        by.setdefault(parts(u)[0].rpartition(".")[2], []).append(y)
    rates = {k: (sum(v) + 10 * prior) / (len(v) + 10) for k, v in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])) if k}
    rows = [features_of(u, rates, prior) for u, _ in labelled]
    bias = math.log(prior / (1 - prior))
    trees: list[tuple] = []
    margin = [bias] * n
    for _ in range(ROUNDS if 0 < ones < n else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [y - q for (_, y), q in zip(labelled, p)], [q * (1 - q) for q in p]
        top = best_cut(rows, list(range(n)), grad, hess)
        if top[1] == math.inf:
            break
        sides = [[i for i in range(n) if rows[i][top[0]] <= top[1]], [i for i in range(n) if rows[i][top[0]] > top[1]]]
        cuts = [c if (c := best_cut(rows, s, grad, hess))[1] != math.inf else (0, 1e300) for s in sides]
        leaves = []
        for s, (f, t) in zip(sides, cuts):
            for leaf in ([i for i in s if rows[i][f] <= t], [i for i in s if rows[i][f] > t]):
                v = RATE * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1)
                leaves.append(v)
                for i in leaf:
                    margin[i] += v
        trees.append((top, *cuts, tuple(leaves)))
    return Trees(bias, trees, rates, prior)


def fit_frame(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> Trees:
    """``fit`` on the ``MAX_LABELLED`` rows of the smallest hashes of a labelled table (label 1: block); rows of null url or label teach nothing."""
    rows = labelled.where(f"{url_col} IS NOT NULL AND {label_col} IN (0, 1)").select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y"))
    return fit([tuple(r) for r in rows.orderBy(F.xxhash64("u"), "u", "y").limit(MAX_LABELLED).collect()])


@cache
def default_trees() -> Trees:
    return fit(labelled_urls())


def ordered(rules) -> list[tuple[str, str, str]]:
    """The rules, the longest first; allow before block."""
    return sorted({tuple(r) for r in rules}, key=lambda r: (-len(r[1] + r[2]), r))


def rule_sql(rules, result: str) -> str:
    """A CASE over host and path: the longest rule that fits, as its name or its verdict."""
    cases = []
    for verdict, host, path in ordered(rules):
        fits = f"(host = {quoted(host)} OR right(host, {len(host) + 1}) = {quoted('.' + host)}) AND left(path, {len(path)}) = {quoted(path)}"
        cases.append(f"WHEN {fits} THEN {quoted(host + path if result == 'rule' else verdict)}")
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS STRING)"


def looked_up(df: DataFrame, key: str, entries: list[tuple], schema: str, name: str) -> DataFrame:
    """``df`` with the entry of ``key``, an expression, in column ``name``: a join, broadcast if the entries are small."""
    own = df.sparkSession.createDataFrame(entries, f"__url_key string, {name} {schema}")
    small = sum(len(repr(e)) for e in entries) * 4 <= BROADCAST_BYTES
    return df.join(F.broadcast(own) if small else own, F.expr(key) == F.col("__url_key"), "left").drop("__url_key")


def with_rules(df: DataFrame, rules) -> DataFrame:
    """``df`` (with host and path) with the longest fitting rule and its verdict in ``__url_rule``, null if none fits.

    For each number of labels that rules' hosts have, the url's last so many labels are looked up among those hosts.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in ordered(rules):
        by_host.setdefault(host, []).append((path, verdict))
    levels = sorted({h.count(".") + 1 for h in by_host})
    for n in levels:
        entries = [(h, v) for h, v in by_host.items() if h.count(".") + 1 == n]
        df = looked_up(df, f"substring_index(host, '.', -{n})", entries, "array<struct<path:string,verdict:string>>", f"__url_level{n}")
    # hosts of more labels are suffixes that hold those of fewer, but the path counts as well: the longest of all that fit
    fits = [f"transform(filter(coalesce(__url_level{n}, array()), r -> startswith(path, r.path)), r -> named_struct('n', -length(substring_index(host, '.', -{n})) - length(r.path), 'verdict', r.verdict, 'host', substring_index(host, '.', -{n}), 'rule', concat(substring_index(host, '.', -{n}), r.path)))" for n in levels]
    first = f"array_min(concat({', '.join(fits)}))" if fits else "CAST(NULL AS struct<n:int,verdict:string,host:string,rule:string>)"
    return df.withColumn("__url_rule", F.expr(first)).drop(*[f"__url_level{n}" for n in levels])


def filter_urls(pages: DataFrame, rules=RULES, trees: Trees | None = None, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), block_margin (over 0: the trees would block) and verdict."""
    trees = trees or default_trees()
    results = ("host", "path", "rule", "block_margin", "verdict")
    df = pages.drop(*[c for c in pages.columns if c.lower() in results and c != url_col]).withColumn("__url_u", F.expr(f"coalesce(`{url_col}`, '')"))
    pieces = {"host": f"translate(regexp_extract(__url_u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')", "path": "regexp_extract(__url_u, '(?s)^.*?://[^/?#]*([^?#]*)', 1)", "__url_rest": "regexp_extract(__url_u, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1)"}
    df = df.withColumns({k: F.expr(v) for k, v in pieces.items()})
    if len(trees.rates) > MOST_CASES:
        df = looked_up(df, "substring_index(host, '.', -1)", list(trees.rates.items()), "double", "__url_rate")
    named = {k: v.replace("(u)", "(__url_u)").replace("(u,", "(__url_u,").replace("(rest", "(__url_rest") for k, v in feature_sql(trees.rates, trees.prior).items()}
    df = df.withColumn("__url_f", F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in named.items()) + ")"))
    margin = trees.sql()
    for k in FEATURES:
        margin = margin.replace(f"{k} <=", f"__url_f.{k} <=")
    if len(rules) > MOST_CASES:
        df = with_rules(df, rules).withColumns({"rule": F.col("__url_rule.rule"), "__url_ruled": F.col("__url_rule.verdict")})
    else:
        df = df.withColumns({"rule": F.expr(rule_sql(rules, "rule")), "__url_ruled": F.expr(rule_sql(rules, "verdict"))})
    df = df.withColumn("block_margin", F.expr(margin)).withColumn("verdict", F.expr("coalesce(__url_ruled, CASE WHEN block_margin > 0 THEN 'block' ELSE 'allow' END)"))
    return df.drop("__url_u", "__url_rest", "__url_f", "__url_rate", "__url_rule", "__url_ruled")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle_op10() -> str:
    trees = default_trees()
    features = ", ".join(f"{v} AS {k}" for k, v in feature_sql(trees.rates, trees.prior, "duckdb").items())
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) AS rest
  FROM pages
), f AS (SELECT *, {features} FROM p), m AS (SELECT *, {trees.sql()} AS margin FROM f)
SELECT page_id, host, path, {rule_sql(RULES, "rule").replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")} AS rule,
       coalesce({rule_sql(RULES, "verdict")}, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""

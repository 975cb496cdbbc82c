"""Registered queries over made commits: bodies, indexes, ticket texts, redaction, and texts for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dossier, gates, history, intent, retrieval, status
from ..settings import DEFAULTS, browse_url
from ..sources import discovery, sinks, tracker
from . import reports
from .catalogue import EMAIL_RE2, query
from .catalogue_more import made
from .standins import table

#: A commit for each order: subjects with a ticket, stock phrases and merges; bodies with a template line, with trailers alone, or empty.
COMMIT_ROWS = (
    "concat('repo-', o_custkey % 5) AS repository ;; o_orderkey AS pos ;; "
    "CASE o_orderkey % 4 WHEN 0 THEN concat('[AB-', o_orderkey % 50, '] Pay the ', o_orderstatus, ' order of ', o_orderpriority, '.') WHEN 1 THEN concat('AB-', o_orderkey % 50, ': wip') WHEN 2 THEN 'No ticket is named here' ELSE 'Merge branch x of AB-7' END AS subject ;; "
    "CASE o_orderkey % 3 WHEN 0 THEN concat('Template line of all commits\\n\\nBecause CD-', o_orderkey % 20, ' the order ', o_orderkey, '\\nwas late by ', o_orderkey, ' days.') WHEN 1 THEN 'Signed-off-by: A <a@x>' ELSE '' END AS body ;; "
    "substring(cast(o_orderdate AS string), 1, 19) AS author_date ;; named_struct('name', if(o_orderkey % 11 = 0, 'renovate[bot]', 'Ann'), 'email', 'a@x') AS author ;; named_struct('name', 'Ann', 'email', 'a@x') AS committer ;; o_orderkey % 4 = 3 AS is_merge ;; o_orderkey"
)
COMMITS_SQL = """
c AS (SELECT o_orderkey AS k, 'repo-' || (o_custkey % 5) AS repo, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey % 11 = 0 AS bot, o_orderkey % 4 AS m,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 <> 0 THEN 'Because CD-' || (o_orderkey % 20) || ' the order ' || o_orderkey END AS head,
  CASE o_orderkey % 4 WHEN 0 THEN 'Pay the ' || o_orderstatus || ' order of ' || o_orderpriority WHEN 1 THEN 'wip' WHEN 2 THEN 'No ticket is named here' END AS subject FROM orders),
t AS (SELECT *, CASE WHEN m < 2 THEN 'AB-' || (k % 50) WHEN head IS NOT NULL THEN 'CD-' || (k % 20) END AS ticket FROM c WHERE m <> 3)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made commits, with the files of the order's line items."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("src/f"), F.col("l_partkey") % 200).alias("path")).distinct().groupBy("l_orderkey").agg(F.collect_list(F.struct("path")).alias("files"))
    rows = made(spark, sf_dir, "orders", COMMIT_ROWS)
    return rows.join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("o_orderkey", "l_orderkey")


@query(
    f"""
WITH {COMMITS_SQL}, f AS (SELECT DISTINCT l_orderkey AS k, 'src/f' || (l_partkey % 200) AS path FROM lineitem), x AS (SELECT t.*, path FROM t JOIN f USING (k) WHERE ticket IS NOT NULL),
n AS (SELECT repo, path, ticket, count(*) AS n, min(k) AS seen FROM x GROUP BY ALL), s AS (SELECT repo, path, min(day) AS first, max(day) AS last FROM x GROUP BY ALL)
SELECT repo, path, array_to_string((list(ticket ORDER BY n DESC, seen, ticket))[1:6], ',') AS tickets, any_value(first) AS first, any_value(last) AS last FROM n JOIN s USING (repo, path) GROUP BY repo, path"""
)
def intent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of commits that aren't merges, with six tickets of subjects or else of bodies."""
    found = intent.file_ticket_index(intent.with_bodies(commits(spark, sf_dir)))
    return intent.file_tickets(found, 6).withColumn("tickets", F.array_join("tickets", ","))


@query(
    f"""
WITH {COMMITS_SQL}, v AS (SELECT ticket, repo || lpad(CAST(k AS VARCHAR), 12, '0') AS seen, CASE WHEN m = 1 THEN CASE WHEN head IS NULL THEN '' ELSE head || ' was late by ' || k || ' days.' END ELSE subject END AS d, subject AS s, coalesce(head || chr(10) || 'was late by ' || k || ' days.', '') AS b FROM t WHERE ticket IS NOT NULL),
u AS (SELECT ticket, 'd' AS field, d AS value, seen FROM v UNION ALL SELECT ticket, 's', s, seen FROM v UNION ALL SELECT ticket, 'b', b, seen FROM v),
g AS (SELECT ticket, field, value, count(*) AS n, min(seen) AS seen FROM u WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticket, field ORDER BY n DESC, CASE WHEN field = 'd' THEN -length(value) ELSE 0 END, CASE WHEN field = 'd' THEN seen ELSE value END) AS rn FROM g)
SELECT ticket, field, value FROM r WHERE rn <= CASE field WHEN 's' THEN 3 ELSE 2 END"""
)
def ticket_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ticket's commits say: two descriptions, three subjects, two bodies."""
    return intent.mined_values(intent.ticket_records(intent.with_bodies(commits(spark, sf_dir))))


@query("SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'automated' ELSE 'too-short' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 GROUP BY 1")
def discarded_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that are discarded, by reason."""
    return intent.discard_report(intent.with_bodies(commits(spark, sf_dir)))


#: Rules of which the later ones meet what the earlier ones have put in.
RULES = {"code": r"\b[A-Z]{2}-\d+", "number": r"\d{4,}", "word": r"withheld|urgent"}


@query(
    r"""
WITH a AS (SELECT o_orderkey AS k, 'AB-' || o_orderkey || ' ' || (o_orderkey * 1000) || ' urgent ' || (o_orderkey % 10) AS t FROM orders), b AS (SELECT *, regexp_replace(t, '\b[A-Z]{2}-\d+', '[code withheld]', 'g') AS t1 FROM a),
c AS (SELECT *, regexp_replace(t1, '\d{4,}', '[number withheld]', 'g') AS t2 FROM b)
SELECT k, regexp_replace(t2, 'withheld|urgent', '[word withheld]', 'g') AS redacted, len(regexp_extract_all(t, '\b[A-Z]{2}-\d+')) AS codes, len(regexp_extract_all(t1, '\d{4,}')) AS numbers, len(regexp_extract_all(t2, 'withheld|urgent')) AS words, 'code' AS first FROM c"""
)
def redact_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order of name, each on what the last has left."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; concat('AB-', o_orderkey, ' ', o_orderkey * 1000, ' urgent ', o_orderkey % 10) AS t")
    counts = X.redaction_counts(F.col("t"), RULES)
    return rows.select("k", X.redact(F.col("t"), RULES).alias("redacted"), *(counts[c].cast("long").alias(f"{c}s") for c in RULES), X.matched_rule(F.col("t"), RULES).alias("first"))


@query("SELECT p_partkey AS k, p_partkey % 3 <> 1 AS only FROM part")
def redaction_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which redaction leaves nothing."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 3 WHEN 0 THEN '[code withheld], [number withheld]!' WHEN 1 THEN '[code withheld] é' ELSE ' - ' END AS t")
    return rows.select("k", X.is_redaction_only(F.col("t"), RULES).alias("only"))


@query(rf"SELECT doc_id AS ticket, 'd' AS field, 'email-address' AS rule, count(*) AS n FROM documents WHERE regexp_matches(coalesce(text, ''), '{EMAIL_RE2}') GROUP BY doc_id")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: stored values that a rule still matches, without the values."""
    values = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket"), F.lit("d").alias("field"), F.col("text").alias("value"))
    return gates.evidence_findings(values)


@query("SELECT o_orderkey AS k, (o_orderkey * 7919) || ' files' AS said, o_orderkey * 7919 AS figure, o_orderkey % 3 = 0 AS stale FROM orders")
def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that reports state, with and without thousands' marks, and reports older than their graph."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; concat(o_orderkey * 7919, ' files') AS said ;; concat('In all ', format_number(o_orderkey * 7919, 0), ' files, 3 folders') AS r ;; if(o_orderkey % 3 = 0, '2024-01-01T00:00:00Z', if(o_orderkey % 3 = 1, 'none', '2024-01-02T00:30:00+01:00')) AS a ;; '2024-01-01T23:00:00Z' AS g")
    return rows.select("k", "said", status.figure(F.col("r"), "files").alias("figure"), status.stale(F.col("a"), F.col("g")).alias("stale"))


@query("SELECT item_id AS k, array_to_string(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(regexp_replace(w, 'ies$', 'y'), 'e?s$', '') ELSE w END), ' ') AS stems FROM benchmark")
def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII words of questions, stemmed."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.array_join(F.transform(X.tokens(F.col("text")), X.stem), " ").alias("stems"))


STOP_SQL = ", ".join(f"'{w}'" for w in sorted(retrieval.STOP))


@query(
    f"""
WITH q AS (SELECT p_partkey AS k, string_split(CASE p_partkey % 3 WHEN 0 THEN 'what is the ' || lower(p_name) || ' and the ' || lower(p_name) WHEN 1 THEN 'what is the' ELSE 'queries of a ' || lower(p_type) || 's' END, ' ') AS w FROM part),
c AS (SELECT k, list_filter(list_filter(list_transform(w, lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> ''), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})) AS c, w FROM q),
s AS (SELECT k, list_transform(CASE WHEN len(c) > 0 THEN c ELSE w END, lambda x: CASE WHEN length(x) > 4 THEN regexp_replace(regexp_replace(x, 'ies$', 'y'), 'e?s$', '') ELSE x END) AS l FROM c)
SELECT k, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS terms FROM s"""
)
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's terms: no stop words unless nothing else is left, stemmed, each once."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 3 WHEN 0 THEN concat('What is the ', p_name, ' and the ', p_name) WHEN 1 THEN 'what is the' ELSE concat('Queries of a ', regexp_replace(p_type, '[^A-Za-z0-9 ]', ''), 's?') END AS q")
    return rows.select("k", F.array_join(retrieval.terms_of(F.col("q")), " ").alias("terms"))


@query("SELECT doc_id AS k, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 80), '(?s)(.) [^ ]*$', '\\1') || '…' END AS clipped FROM documents")
def clipped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts clipped at a word, with an ellipsis."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), X.clip_words(F.col("text"), 80).alias("clipped"))


@query(r"SELECT p_partkey AS k, regexp_replace(regexp_replace(regexp_replace(lower(p_name || '--' || p_type || '/' || p_brand || '#'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS id FROM part")
def normal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of letters, digits and single underscores."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), X.norm_id(F.concat("p_name", F.lit("--"), "p_type", F.lit("/"), "p_brand", F.lit("#"))).alias("id"))


@query("SELECT page_id AS k, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, regexp_replace(coalesce(url, ''), '([\\\\|])', '\\\\\\1', 'g') AS md FROM pages")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for HTML and for Markdown tables."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), X.escape_html(F.col("html")).alias("html"), X.escape_markdown(F.col("url")).alias("md"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'x/f' || p_partkey ELSE '/other/f' || p_partkey END AS kept, CASE p_partkey % 3 WHEN 0 THEN '/store/x/f' || p_partkey ELSE '/other/f' || p_partkey END AS whole FROM part")
def store_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are kept, and back."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; if(p_partkey % 3 = 0, concat('/store/x/f', p_partkey), concat('/other/f', p_partkey)) AS p")
    kept = rows.select("k", discovery.store_relative(F.col("p"), "/store/").alias("kept"))
    return kept.withColumn("whole", discovery.absolute(F.col("kept"), "/store"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'https://t.example/browse/' ELSE 'https://t.example/?q=' END || 'AB-' || p_partkey AS link FROM part")
def browse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket links behind a prefix that a slash completes where nothing else does."""
    one, two = browse_url(" https://t.example/browse "), browse_url("https://t.example/?q=")
    ticket = F.concat(F.lit("AB-"), "p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, X.browse_link(ticket, one)).otherwise(X.browse_link(ticket, two)).alias("link"))


@query("SELECT asked, CAST(wait AS DOUBLE) AS wait FROM (VALUES ('7', 7.0), ('-3', 0.0), ('999', 300.0), ('soon', 1.0), ('2.5', 2.5)) v(asked, wait)")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a server's wish makes a request wait."""
    asked = ("7", "-3", "999", "soon", "2.5")
    return spark.createDataFrame([(a, tracker.retry_delay(a)) for a in asked], "asked string, wait double")


@query(
    """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN substr(CAST(o_orderdate AS VARCHAR), 1, 10) || ' (`' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '`)' ELSE '—' END AS cell FROM orders"""
)
def synced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and short sha of a sync, or a dash."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; if(o_orderkey % 3 = 0, concat(lpad(o_orderkey, 8, '0'), 'ffff'), if(o_orderkey % 3 = 1, '', NULL)) AS sha ;; cast(o_orderdate AS string) AS committed")
    return rows.select("k", reports.synced_cell().alias("cell"))


@query(
    """
WITH c AS (SELECT conv_id AS k, list(text ORDER BY turn) AS l FROM conversations WHERE text IS NOT NULL GROUP BY conv_id), h AS (SELECT *, list_filter(l, lambda x: contains(lower(x), 'the')) AS h FROM c)
SELECT k, array_to_string(list_transform(CASE WHEN len(h) > 0 THEN h[1:3] ELSE l[1:1] END, lambda x: CASE WHEN length(x) <= 40 THEN x ELSE regexp_replace(substr(x, 1, 40), '(?s)(.) [^ ]*$', '\\1') || '…' END), ' | ') AS rows FROM h"""
)
def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: three comments that carry a term, or else the first."""
    own = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy(F.col("conv_id").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("comments"))
    return own.select("k", F.array_join(reports.comment_rows(["the"], chars=40), " | ").alias("rows"))


@query("SELECT doc_id AS ticket, 'd' AS field, CASE WHEN contains(lower(text), 'nicht') THEN 'nicht' ELSE 'the' END AS term FROM documents WHERE contains(lower(text), 'nicht') OR contains(lower(text), 'the')")
def carried_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: evidence that carries a term, and the first it carries; one letter is none."""
    values = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket"), F.lit("d").alias("field"), F.col("text").alias("value"))
    return reports.matching_evidence(values, ["x", "nicht", "the"]).select("ticket", "field", "term")


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'else of ' || p_name ELSE '' END AS others FROM part")
def other_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that say something else than what is shown."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; concat('Pay the ', p_name) AS shown ;; array(concat('PAY, the ', p_name, '!'), 'pay', concat('So: pay the ', p_name, ' now'), if(p_partkey % 3 = 0, concat('else of ', p_name), 'the')) AS l")
    return rows.select("k", F.array_join(reports.other_subjects(F.col("l"), F.col("shown")), ",").alias("others"))


@query("SELECT o_custkey % 7 AS question, CASE WHEN o_custkey % 7 = 3 THEN 'lost' ELSE 'moved' END AS state FROM orders WHERE o_custkey % 7 IN (3, 5) GROUP BY ALL")
def lost_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose answers are gone or others than the baseline's."""
    q = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("question")).distinct()
    both = F.array(F.lit("tickets"), F.lit("graph"))
    k = F.col("question")
    before = q.withColumn("met", F.array(F.lit("graph"), F.lit("tickets")))
    now = q.where("question <> 3").withColumn("met", F.when(k == 5, F.array(F.lit("brief"))).otherwise(both))
    return reports.lost_answers(before, now).select("question", "state")


@query(
    r"""
SELECT p_partkey AS k, '<h2>Part ' || p_partkey || '</h2>' || chr(10) || '<table class=''rt''><tr><th>a</th><th>b</th></tr><tr><td>' || p_size || '</td><td><b>x</b></td></tr></table>' || chr(10)
  || '<ul><li>see <a href="https://t.example/AB-' || p_partkey || '" target="_blank" rel="noopener">AB-' || p_partkey || '</a></li><li><code>c</code> &lt;i&gt;</li></ul>' || chr(10) || '<p>in <a href="https://github.com/o/part-repo" target="_blank" rel="noopener">part-repo</a> but not part-repos</p>' AS html FROM part"""
)
def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constrained Markdown as HTML, with links for tickets and repositories."""
    md = "concat('# Part ', p_partkey, '\\n| a | b |\\n|---|---:|\\n| ', p_size, ' | **x** |\\n\\n- see AB-', p_partkey, '\\n- `c` <i>\\n\\nin part-repo\\nbut not part-repos')"
    rows = made(spark, sf_dir, "part", f"p_partkey AS k ;; {md} AS md")
    return sinks.to_html(rows, "md", base="https://t.example/", ticket=r"\b([A-Z]{2}-\d+)\b", repos=["part-repo"], org="o").select("k", "html")


@query(
    r"""
SELECT o_orderkey AS k, '## ' || substr(lpad(CAST(o_orderkey AS VARCHAR), 40, '0'), 1, 8) || ': A \| ' || o_orderpriority || chr(10) || chr(10) || '- **Commit:** `' || lpad(CAST(o_orderkey AS VARCHAR), 40, '0') || '`' || chr(10) || '- **Date:** 2024' || chr(10) || '- **Author:** Ann' || chr(10)
  || '- **Repository:** `r`' || chr(10) || '- **Parents:** ' || CASE WHEN o_orderkey % 2 = 0 THEN '`p1`, `p2`' ELSE 'None' END || chr(10) || '- **Merge commit:** ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END || chr(10) || '- **Files changed:** 1' || chr(10) || '- **Lines:** +3 / -0' || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '### Commit message' || chr(10) || chr(10) || 'Said ' || o_orderstatus || chr(10) ELSE '' END
  || chr(10) || '### Changed files' || chr(10) || chr(10) || '| File | Additions | Deletions |' || chr(10) || '|---|---:|---:|' || chr(10) || '| `a.py` | 3 | binary |' || chr(10) || chr(10) || '---' || chr(10) AS md FROM orders"""
)
def commit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K4: commits as Markdown sections."""
    sql = (
        "o_orderkey AS k ;; lpad(o_orderkey, 40, '0') AS sha ;; substring(lpad(o_orderkey, 40, '0'), 1, 8) AS short_sha ;; concat('A | ', o_orderpriority) AS subject ;; '2024' AS author_date ;; named_struct('name', 'Ann') AS author ;; 'r' AS repository ;; "
        "if(o_orderkey % 2 = 0, array('p1', 'p2'), array()) AS parents ;; o_orderkey % 2 = 0 AS is_merge ;; 1 AS file_count ;; 3 AS additions ;; 0 AS deletions ;; array() AS refs ;; if(o_orderkey % 3 = 0, concat(' Said ', o_orderstatus, '\\n'), NULL) AS body ;; array(named_struct('path', 'a.py', 'additions', 3, 'deletions', CAST(NULL AS INT))) AS files"
    )
    return made(spark, sf_dir, "orders", sql).select("k", sinks.commit_markdown().alias("md"))


@query(
    """
SELECT 'estate' AS scope, 'r' || coalesce(o.k, n.k) AS name, CASE WHEN o.k IS NOT NULL AND (n.k IS NULL OR failed) THEN 'old' ELSE 'new' END AS sha, coalesce(failed, false) AS sync_failed
FROM (SELECT p_partkey AS k FROM part) o FULL JOIN (SELECT 2 * p_partkey AS k, p_partkey % 3 = 0 AS failed FROM part) n ON o.k = n.k"""
)
def provenance_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new record replaces the old one, a failed sync keeps it."""
    cols = "'estate' AS scope ;; concat('r', {1} * p_partkey) AS name ;; '{0}' AS sha ;; 'main' AS branch ;; '2024' AS committed"
    old = made(spark, sf_dir, "part", cols.format("old", 1))
    new = made(spark, sf_dir, "part", cols.format("new", 2) + " ;; p_partkey % 3 = 0 AS sync_failed")
    return sinks.merged_provenance(old, new).select("scope", "name", "sha", "sync_failed")


@query("SELECT o_custkey % 20 AS repo, max(o_orderkey % 13) AS behind FROM orders GROUP BY 1 HAVING max(o_orderkey % 13) > 11")
def drifted_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories behind their source."""
    drift = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("repo")).agg((F.max(F.col("o_orderkey") % 13)).alias("behind"))
    return status.behind(drift.where("behind > 11"))


@query("SELECT 'known' AS side, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT 2 * p_partkey FROM part) UNION ALL SELECT 'merged', 2 * p_partkey FROM part WHERE 2 * p_partkey NOT IN (SELECT p_partkey FROM part)")
def merge_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known and not merged, and the other way."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    known, merged = dossier.merge_accounts(p, p.select((2 * F.col("k")).alias("k")), "k")
    return known.select(F.lit("known").alias("side"), "k").unionByName(merged.select(F.lit("merged").alias("side"), "k"))


@query("SELECT o_orderpriority AS repository, count(*) AS n, max(substr(CAST(o_orderdate AS VARCHAR), 1, 10)) AS newest FROM orders GROUP BY 1")
def history_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and newest record of exported histories."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repository"), F.col("o_orderdate").cast("string").alias("author_date"), F.col("o_orderkey").alias("pos"))
    return history.exported(rows).select("repository", "n", F.substring("newest", 1, 10).alias("newest"))


@query(f"SELECT {DEFAULTS.min_entry_degree} AS before, 7 AS after, true AS unknown_refused, true AS nonsense_refused")
def settings_of_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from an environment, by type; unknown names and nonsense are refused."""
    from ..settings import from_environment

    def refused(env: dict[str, str]) -> bool:
        try:
            from_environment(env, "EL_")
        except ValueError:
            return True
        return False

    after = from_environment({"EL_MIN_ENTRY_DEGREE": " 7 ", "OTHER": "x"}, "EL_").min_entry_degree
    return spark.createDataFrame([(DEFAULTS.min_entry_degree, after, refused({"EL_NO_SUCH": "1"}), refused({"EL_MIN_ENTRY_DEGREE": "many"}))], "before int, after int, unknown_refused boolean, nonsense_refused boolean")

"""The registered queries of the estate operators over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dossier, gates, graph, history, intent, layers, resolve, retrieval, semantic
from .standins import ENTRIES_SQL, INDEX_SQL, LINKS_SQL, NODES_SQL, entries, index, links, nodes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SUBJECT_SQL = "'[PROJ-' || (o_orderkey % 997) || '] ' || o_orderpriority || ' see OPS-' || (o_custkey % 101) || ' and PROJ-' || (o_orderkey % 997) || '.'"


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("[PROJ-"), F.col("o_orderkey") % 997, F.lit("] "), "o_orderpriority", F.lit(" see OPS-"), F.col("o_custkey") % 101, F.lit(" and PROJ-"), F.col("o_orderkey") % 997, F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", subject.alias("subject"))


# --- text ---------------------------------------------------------------


@query(
    rf"""
WITH s AS (SELECT o_orderkey, regexp_extract_all({SUBJECT_SQL}, '\b([A-Z][A-Z0-9]{{1,9}}-\d{{1,6}})\b', 1) AS l FROM orders)
SELECT o_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tickets FROM s"""
)
def ticket_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket ids of subjects, first appearances in order."""
    return subjects(spark, sf_dir).select("o_orderkey", F.array_join(X.tickets_of(F.col("subject")), ",").alias("tickets"))


@query(
    rf"""
SELECT o_orderkey, regexp_replace(regexp_replace({SUBJECT_SQL}, '^([\s\[\(]*[A-Z][A-Z0-9]{{1,9}}-\d{{1,6}}[\]\)]*[\s:,\-–]*\s*)+', ''), '^[ .]+|[ .]+$', '', 'g') AS description FROM orders"""
)
def description_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects without leading ticket references."""
    return subjects(spark, sf_dir).select("o_orderkey", X.clean_description(F.col("subject")).alias("description"))


EMAIL_RE2 = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]{2,}"


@query(
    rf"""
WITH t AS (SELECT 'documents' AS origin, coalesce(text, '') AS x FROM documents UNION ALL SELECT 'conversations', coalesce(text, '') FROM conversations)
SELECT origin, count(*) AS texts, CAST(sum(len(regexp_extract_all(x, '{EMAIL_RE2}'))) AS BIGINT) AS matches,
       CAST(count(*) FILTER (WHERE regexp_matches(x, '{EMAIL_RE2}')) AS BIGINT) AS touched FROM t GROUP BY origin"""
)
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the redaction rules by origin."""
    both = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text").unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), "text"))
    counts = X.redaction_counts(F.col("text"))["email-address"]
    return both.groupBy("origin").agg(F.count("*").alias("texts"), F.sum(counts).cast("long").alias("matches"), F.count(X.matched_rule(F.col("text"))).alias("touched"))


@query(
    r"""
WITH b AS (SELECT source, doc_id, text FROM documents WHERE regexp_matches(coalesce(text, ''), '\S')),
n AS (SELECT source, count(*) AS bodies FROM b GROUP BY source),
l AS (SELECT DISTINCT source, doc_id, lower(trim(regexp_replace(u.x, '\s+', ' ', 'g'))) AS line FROM b, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x) u)
SELECT l.source AS repo, line, count(*) AS seen, any_value(bodies) AS bodies FROM l JOIN n USING (source) WHERE length(line) >= 8
GROUP BY l.source, line HAVING count(*) >= 5 AND count(*) * 100 >= any_value(bodies) * 2"""
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a source's documents repeat enough to be templates."""
    return intent.learn_boilerplate(table(spark, sf_dir, "documents"), repo="source", body="text", rules={}).select("repo", "line", "seen", "bodies")


KEEP_SQL = r"""(NOT regexp_matches(lower(ltrim(x)), '^(co-authored-by:|signed-off-by:|reviewed-by:|change-id:|cherry-picked:|on-behalf-of:)')
  AND NOT regexp_matches(trim(x), '^[-=]{3,}$')
  AND NOT (regexp_matches(trim(x), '^[A-Za-z][A-Za-z0-9-]{1,30}:') AND NOT regexp_matches(trim(x), '(?i)^(bumps \[|dependency-type:|- \[release notes\]|updated-dependencies:|author: )')
    AND NOT regexp_matches(trim(x), '^[A-Z][A-Z0-9]{1,9}(-\d{1,6})?:')
    AND (regexp_matches(trim(x), '^[A-Za-z0-9]*-[A-Za-z0-9-]*:') OR NOT contains(trim(regexp_extract(trim(x), '^[A-Za-z0-9-]+:(.*)$', 1)), ' '))))"""


@query(
    rf"""
WITH l AS (SELECT doc_id, u.i, rtrim(u.x) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, LATERAL (SELECT unnest(range(len(ls))) AS i, unnest(ls) AS x) u),
f AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE x <> '' AND {KEEP_SQL}), '') AS flat FROM l GROUP BY doc_id),
r AS (SELECT doc_id, flat, CASE WHEN regexp_matches(flat, '(?i)dependabot') OR regexp_matches(flat, '(?im)^[ \t]*(bumps \[|dependency-type:|- \[release notes\]|updated-dependencies:)') THEN 'bot-text'
  WHEN regexp_matches(flat, '(?im)^[ \t]*author: ') THEN 'squashed-authors' WHEN len(regexp_extract_all(flat, '(?m)^[ \t]*\* ')) >= 2 THEN 'merge-list'
  WHEN length(flat) < 25 THEN 'too-short' ELSE '' END AS reason FROM f)
SELECT doc_id, reason, CAST(CASE WHEN reason = '' THEN length(flat) ELSE 0 END AS BIGINT) AS prose_chars FROM r"""
)
def clean_body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a body is rejected, and how much prose is left."""
    b = table(spark, sf_dir, "documents").select("doc_id", X.body_columns(F.col("text")).alias("b"))
    return b.select("doc_id", "b.reason", F.length("b.prose").cast("long").alias("prose_chars"))


@query(
    r"""
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(regexp_replace(substr(text, 1, 300), '(?s) [^ ]*$', ''), '\s+$', '') END AS head FROM documents"""
)
def truncate_300(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at a word boundary."""
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 300).alias("head"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS v, 'k=' || json_extract_string(props, '$.k') AS summary FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a map, and its summary."""
    config = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(config, "k").alias("v"), X.deployment_summary(config).alias("summary"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of markup."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("visible"))


@query(r"""SELECT page_id, u.b AS block FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>(.*?)</script>', 1) AS bs FROM pages) p, LATERAL (SELECT unnest(bs) AS b) u""")
def block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks embedded in pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.matches(X.text("html"), r"(?s)<script[^>]*>(.*?)</script>")).alias("block"))


@query(
    r"""
WITH q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '^a "' || p_name || '" costs <price>$' WHEN 1 THEN 'the {int} items of ' || p_name || ' (and|or) 12' ELSE p_name || ' has {amount:d} left' END AS s FROM part)
SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^[\^$]+|[\^$]+$', '', 'g'),
  '\{[a-zA-Z_]*(:[^}]*)?\}', '¤', 'g'), '\((\?:)?[^)]*\)', '¤', 'g'), '"[^"]*"', '¤', 'g'), '<[^>]*>', '¤', 'g'), '\b\d+\b', '¤', 'g'), '\s+', ' ', 'g'))) AS step FROM q"""
)
def step_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step patterns with their parameters as placeholders."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('^a "'), name, F.lit('" costs <price>$'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("the {int} items of "), name, F.lit(" (and|or) 12"))).otherwise(F.concat(name, F.lit(" has {amount:d} left")))
    return p.select("p_partkey", X.normalise_step(s).alias("step"))


# --- evidence -----------------------------------------------------------


@query(
    f"""
WITH x AS ({INDEX_SQL}), f AS (SELECT path, min(day) AS first, max(day) AS last FROM x GROUP BY path)
SELECT x.path, ticket, count(*) AS n, any_value(first) AS first, any_value(last) AS last FROM x JOIN f USING (path) GROUP BY x.path, ticket"""
)
def file_ticket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: files and their tickets with counts, and each file's first and last day. Counts pre-aggregate; the file's days join on the shuffled path."""
    x = index(spark, sf_dir)
    counts = x.groupBy("path", "ticket").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    span = counts.groupBy("path").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    return counts.join(span, "path").select("path", "ticket", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query(
    """
SELECT l_orderkey AS ticket, count(*) AS n, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS repos, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey"""
)
def ticket_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a ticket's commits, repositories and days."""
    nation = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.to_date("l_shipdate").alias("day")).join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("l_orderkey").alias("ticket")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("repos"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))


@query(
    f"""
WITH x AS (SELECT DISTINCT path, ticket FROM ({INDEX_SQL})), s AS (SELECT ticket FROM x GROUP BY ticket HAVING count(*) BETWEEN 2 AND 40)
SELECT a.path AS a, b.path AS b, count(*) AS n FROM x a JOIN x b ON a.ticket = b.ticket AND a.path < b.path WHERE a.ticket IN (SELECT ticket FROM s) GROUP BY a.path, b.path HAVING count(*) >= 3"""
)
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that change together."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("ticket"))
    return history.cochange_pairs(x, least=3)


HOT_SQL = """
d AS (SELECT l_partkey AS path, count(*) AS degree, count(DISTINCT l_orderkey) AS tickets FROM lineitem GROUP BY l_partkey),
q AS (SELECT degree AS bar FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM d) WHERE i = CAST(floor(n * 0.75) AS BIGINT))"""


@query(f"WITH {HOT_SQL} SELECT path, degree, tickets FROM (SELECT * FROM d ORDER BY tickets DESC, path LIMIT 15) WHERE degree >= (SELECT bar FROM q)")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most churned files whose degree is in the top quarter."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("degree"), F.count_distinct("l_orderkey").alias("tickets"))
    return history.hotspots(files)


@query("SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year, count(*) AS n FROM orders GROUP BY 1")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets by year."""
    return history.timeline(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT p_name AS label, count(DISTINCT p_brand) AS n, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS repos FROM part WHERE p_brand <> 'Brand#1' AND p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#1' AND p_name LIKE '%t') GROUP BY p_name")
def coupling_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that one repository shares with others."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("repo"))
    return history.coupling_surface(n, "Brand#1", suffix="t").select("label", "n", F.array_join("repos", ",").alias("repos"))


@query("SELECT count(*) AS described, round(count(*) FILTER (WHERE p_partkey % 5 IN (0, 3)) / count(*), 6) AS revert_share, round(count(*) FILTER (WHERE p_partkey % 5 IN (1, 3)) / count(*), 6) AS fix_share FROM part")
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of descriptions that speak of reverts and fixes, among some that only sound so."""
    said = "CASE p_partkey % 5 WHEN 0 THEN concat('REVERTED ', p_name) WHEN 1 THEN concat('A Hotfix for ', p_name) WHEN 2 THEN 'prefix, debug and irrevertible' WHEN 3 THEN 'bugs: revert' ELSE p_name END"
    out = history.instability(table(spark, sf_dir, "part"), F.expr(said))
    return out.select("described", F.round("revert_share", 6).alias("revert_share"), F.round("fix_share", 6).alias("fix_share"))


@query(
    """
SELECT coalesce(d.doc_id, l.doc_id) AS ticket, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'title-' || l.doc_id END AS title, d.doc_id IS NOT NULL AS mined
FROM documents d FULL OUTER JOIN (SELECT 2 * doc_id AS doc_id, quality, toxic FROM labels WHERE NOT (quality = 0 AND toxic = 1)) l ON d.doc_id = l.doc_id"""
)
def tracker_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined evidence with the tracker's, whose ids are doubled, so that each side has some alone; absent ones add nothing, denied ones a bare record."""
    mined = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket"), F.array().cast("array<string>").alias("d"), F.lit(True).alias("_mined"))
    outcome = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "absent").when(F.col("quality") == 1, "fetched").otherwise("denied")
    tracker = table(spark, sf_dir, "labels").select((2 * F.col("doc_id")).alias("ticket"), outcome.alias("outcome"), F.concat(F.lit("title-"), 2 * F.col("doc_id")).alias("summary"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("comments"))
    return intent.merge_tracker(mined, tracker).select("ticket", "title", F.coalesce("_mined", F.lit(False)).alias("mined"))


@query("SELECT prefix, state, count(*) AS n FROM (SELECT 'P' || (o_custkey % 9) AS prefix, CASE WHEN o_custkey % 9 = 3 THEN 'denied' WHEN o_custkey % 9 < 5 THEN 'allowed' ELSE 'undecided' END AS state FROM orders) GROUP BY ALL")
def prefix_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket prefixes by what is decided about them."""
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.col("o_custkey") % 9, F.lit("-"), "o_orderkey").alias("ticket"))
    return gates.prefix_states(keys, ("P0", "P1", "P2", "P3", "P4"), ("P3",))


@query("SELECT user_id, arg_max(substr(CAST(ts AS VARCHAR), 1, 10), ts) AS latest FROM events GROUP BY user_id")
def latest_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each group's latest instant."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("string").alias("committed"))
    return gates.latest_synced(e, "user_id")


# --- graph --------------------------------------------------------------


@query(f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({LINKS_SQL}) UNION ALL SELECT target FROM ({LINKS_SQL})) GROUP BY id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: link ends by node."""
    return graph.degree(links(spark, sf_dir))


@query(f"SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({LINKS_SQL}) UNION ALL SELECT target FROM ({LINKS_SQL})) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with the most links."""
    return history.top(graph.degree(links(spark, sf_dir)), 20, F.desc("degree"), "id")


DEGREE_SQL = f"deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ({LINKS_SQL}) UNION ALL SELECT target FROM ({LINKS_SQL})) GROUP BY id)"


@query(
    f"""
WITH e AS (SELECT DISTINCT source, target FROM ({LINKS_SQL})), s AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e), {DEGREE_SQL}, n AS ({NODES_SQL}),
x AS (SELECT node, other, label AS other_label, degree, row_number() OVER (PARTITION BY node, label ORDER BY degree DESC, other) AS r1 FROM s JOIN n ON s.other = n.id JOIN deg ON deg.id = other WHERE node <> other AND label <> '')
SELECT node, other_label, degree, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY degree DESC, other) AS rank FROM x WHERE r1 = 1) WHERE rank <= 5"""
)
def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of different labels for each node."""
    return graph.top_neighbours(nodes(spark, sf_dir), links(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


ENTRY_SQL = f"""
j AS (SELECT n.*, coalesce(degree, 0) AS degree FROM ({NODES_SQL}) n LEFT JOIN deg USING (id)),
ent AS (SELECT *, CASE kind WHEN 'gherkin_feature' THEN 'feature' WHEN 'gherkin_scenario' THEN 'scenario' WHEN 'jira_ticket' THEN 'ticket' ELSE coalesce(kind, '') END AS k FROM j),
kept AS (SELECT id, label, degree, pos, CASE WHEN k IN ('feature', 'scenario', 'ticket', 'deployment', 'environment') THEN k WHEN file_type = 'code' THEN 'code' ELSE 'concept' END AS entry_kind FROM ent
  WHERE CASE WHEN coalesce(label, '') = '' THEN false WHEN k IN ('deployment', 'environment') THEN true WHEN regexp_matches(label, '^[A-Za-z_$]{{1,3}}(\\(\\))?$') THEN false WHEN k IN ('feature', 'scenario', 'ticket') THEN true
    WHEN type = 'package' THEN true WHEN label LIKE '.%' THEN false WHEN contains(coalesce(source_file, ''), '.spec.') OR contains(coalesce(source_file, ''), '__tests__') OR contains(coalesce(source_file, ''), '/test/') THEN false ELSE degree >= 25 END)"""


@query(f"WITH {DEGREE_SQL}, {ENTRY_SQL} SELECT id, degree, entry_kind FROM kept")
def entry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes are entries, and of what kind; the bar is raised to 25 so that it bites."""
    from ..settings import DEFAULTS

    return graph.entries(nodes(spark, sf_dir), links(spark, sf_dir), DEFAULTS.with_overrides({"min_entry_degree": 25})).select("id", "degree", "entry_kind")


@query(
    f"""
WITH {DEGREE_SQL}, {ENTRY_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY degree DESC, pos) - 1 AS eid FROM kept)
SELECT DISTINCT least(a.eid, b.eid) AS s, greatest(a.eid, b.eid) AS t FROM ({LINKS_SQL}) l JOIN r a ON l.source = a.id JOIN r b ON l.target = b.id WHERE a.eid <> b.eid"""
)
def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries that a link joins, by rank."""
    from ..settings import DEFAULTS

    own = graph.entries(nodes(spark, sf_dir), links(spark, sf_dir), DEFAULTS.with_overrides({"min_entry_degree": 25}))
    return graph.kept_edges(links(spark, sf_dir), graph.with_rank(own.select("id", "degree", "pos"), F.desc("degree"), F.col("pos")))


@query("SELECT o_orderpriority AS layer, count(*) AS nodes, CAST(count(*) FILTER (WHERE o_orderkey % 2 = o_orderkey % 3 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS BIGINT) AS joined, count(*) FILTER (WHERE o_orderkey % 2 = o_orderkey % 3 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) = 0 AS dead FROM orders GROUP BY 1")
def join_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each layer the index knows, by repository and file."""
    n = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("source_file"), F.col("o_orderpriority").alias("_origin"))
    ix = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).cast("string").alias("repo"), F.col("l_orderkey").cast("string").alias("path"))
    return gates.join_cardinality(n, ix)


BFS_SQL = f"""
e AS (SELECT DISTINCT source, target FROM ({LINKS_SQL})), s AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e),
h1 AS (SELECT DISTINCT other AS node FROM s WHERE node = 'p7' AND other <> 'p7'), h2 AS (SELECT DISTINCT other AS node FROM s WHERE node IN (SELECT node FROM h1) AND other <> 'p7' AND other NOT IN (SELECT node FROM h1)),
reach AS (SELECT 'p7' AS node, 0 AS dist UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""


@query(f"WITH {BFS_SQL} SELECT node, dist FROM reach")
def bfs_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: nodes within two hops."""
    edges = graph.both_ways(links(spark, sf_dir))
    return graph.bfs(edges, spark.createDataFrame([("p7",)], "node string"), 2)


@query(f"WITH {BFS_SQL} SELECT repo, count(*) AS reached, count(DISTINCT community) AS communities FROM reach JOIN ({NODES_SQL}) n ON reach.node = n.id GROUP BY repo")
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change could reach, by repository."""
    edges = graph.both_ways(links(spark, sf_dir))
    return graph.impact(graph.bfs(edges, spark.createDataFrame([("p7",)], "node string"), 2, 2000), nodes(spark, sf_dir))


@query("SELECT lower(p_name) AS label_lower, count(*) AS n_nodes, count(DISTINCT p_brand) AS n_repos, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS repos, count(DISTINCT p_brand) > 1 AS independent FROM part GROUP BY 1")
def which_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which repositories a label is found."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("repo"))
    return graph.same_label(n).withColumn("repos", F.array_join("repos", ","))


@query("SELECT p_brand AS repo, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_name))), ',') AS labels FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5) GROUP BY 1")
def where_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct neighbours of a node, by repository."""
    edges = table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("node"), F.col("l_partkey").alias("other")).distinct()
    return retrieval.where_used(edges, entries(spark, sf_dir), [-6]).withColumn("labels", F.array_join("labels", ","))


OLD_NEW_SQL = "m AS (SELECT c_custkey, c_nationkey AS o, CASE WHEN c_custkey % 10 < 7 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END AS nw FROM customer)"
OVER_SQL = f"""{OLD_NEW_SQL}, sh AS (SELECT CAST(o AS VARCHAR) AS old, CAST(nw AS VARCHAR) AS new, count(*) AS shared, min(c_custkey) AS first FROM m GROUP BY 1, 2),
os AS (SELECT CAST(o AS VARCHAR) AS old, count(*) AS old_size FROM m GROUP BY 1), ns AS (SELECT CAST(nw AS VARCHAR) AS new, count(*) AS new_size FROM m GROUP BY 1)"""


def _memberships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    new = F.when(F.col("c_custkey") % 10 < 7, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 1) % 25)
    return c.select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("string").alias("community")), c.select(F.col("c_custkey").alias("node_id"), new.cast("string").alias("community"))


@query(f"WITH {OVER_SQL} SELECT old, new, shared, first, old_size, new_size, round(shared / old_size, 6) AS recall, round(shared / new_size, 6) AS precision FROM sh JOIN os USING (old) JOIN ns USING (new)")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared members of old and new communities."""
    return graph.overlaps(*_memberships(spark, sf_dir)).withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


REMAP_SQL = f"""{OVER_SQL}, x AS (SELECT old, new, shared, shared / old_size AS recall, shared / new_size AS precision, row_number() OVER (PARTITION BY old ORDER BY shared DESC, first, new) AS rn FROM sh JOIN os USING (old) JOIN ns USING (new)),
y AS (SELECT *, recall >= 0.6 AND precision >= 0.2 AS ok FROM x WHERE rn = 1), z AS (SELECT *, row_number() OVER (PARTITION BY new, ok ORDER BY recall DESC, length(old), old) AS place FROM y),
claims AS (SELECT old, new, shared, recall, precision, CASE WHEN recall < 0.6 THEN 'below-bar' WHEN precision < 0.2 THEN 'imprecise' WHEN place > 1 THEN 'collision' ELSE 'carried' END AS outcome FROM z)"""


@query(f"WITH {REMAP_SQL} SELECT old, new, shared, outcome FROM claims")
def membership_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where old communities land, after the refusals."""
    old, new = _memberships(spark, sf_dir)
    graph.check_remap(old, new)
    return graph.remap(old, new).select("old", "new", "shared", "outcome")


@query(f"WITH {REMAP_SQL} SELECT CASE WHEN precision >= 0.8 THEN '0.8' WHEN precision >= 0.5 THEN '0.5' WHEN precision >= 0.2 THEN '0.2' ELSE '0.0' END AS band, count(*) AS n FROM claims GROUP BY 1")
def precision_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by precision."""
    return graph.precision_bands(graph.remap(*_memberships(spark, sf_dir)))


@query(
    """
WITH o AS (SELECT o_custkey AS c, count(*) AS degree FROM orders GROUP BY 1),
n AS (SELECT c_nationkey AS community, c_custkey, c_name, c_mktsegment, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(degree, 0) DESC, c_custkey) AS rn FROM customer LEFT JOIN o ON c_custkey = c),
z AS (SELECT community, count(*) AS size FROM n GROUP BY 1 HAVING count(*) >= 25),
r AS (SELECT community, c_mktsegment, count(*) AS k, min(rn) AS first FROM n GROUP BY 1, 2), r4 AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, first) AS q FROM r)
SELECT CAST(z.community AS BIGINT) AS community, size, (SELECT string_agg(c_mktsegment, ',' ORDER BY q) FROM r4 WHERE r4.community = z.community AND q <= 4) AS repositories,
       (SELECT string_agg(c_name, ',' ORDER BY rn) FROM n WHERE n.community = z.community AND rn <= 12) AS top_nodes FROM z"""
)
def community_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of communities; customers by nation, by their orders."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("repo"), F.lit(None).cast("string").alias("source_file"), F.col("c_nationkey").cast("long").alias("community"), F.lit(None).cast("string").alias("kind"))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("degree"))
    return dossier.community_digest(c, d).select("community", "size", F.array_join("repositories", ",").alias("repositories"), F.array_join("top_nodes", ",").alias("top_nodes"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'new' ELSE l_returnflag END AS layer FROM lineitem")
def layer_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layer's rows replaced."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("_origin"))
    none = spark.createDataFrame([], "source string, target string")
    fresh = rows.where("_origin = 'R'").withColumn("_origin", F.lit("new"))
    out, _ = graph.replace_layer(rows, none, "R", fresh, none)
    return out.select("l_orderkey", "l_linenumber", F.col("_origin").alias("layer"))


CHUNK_NODES_SQL = """
SELECT 'c' || (p_partkey % 5) AS chunk, 'n' || (p_partkey % 300) AS id, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'code' ELSE 'doc' END AS file_type, 'src/' || lower(p_brand) || '/f' || (p_partkey % 300) || '.md' AS source_file FROM part
UNION ALL SELECT 'c' || (s_suppkey % 3), 'svc_' || s_suppkey, 'registry.example/img:' || (s_suppkey % 40), 'concept', 'deploy/' || s_suppkey || '.yaml' FROM supplier"""


def _chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = F.col("p_partkey")
    a = p.select(F.concat(F.lit("c"), key % 5).alias("chunk"), F.concat(F.lit("n"), key % 300).alias("id"), F.col("p_name").alias("label"), F.when(key % 2 == 0, "code").otherwise("doc").alias("file_type"), F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/f"), key % 300, F.lit(".md")).alias("source_file"))
    k = F.col("s_suppkey")
    b = s.select(F.concat(F.lit("c"), k % 3).alias("chunk"), F.concat(F.lit("svc_"), k).alias("id"), F.concat(F.lit("registry.example/img:"), k % 40).alias("label"), F.lit("concept").alias("file_type"), F.concat(F.lit("deploy/"), k, F.lit(".yaml")).alias("source_file"))
    return a.unionByName(b)


MERGE_SQL = f"""
cn AS ({CHUNK_NODES_SQL}), ids AS (SELECT id, label, file_type, list_sort(list_distinct(list(source_file))) AS files, count(*) AS seen FROM cn GROUP BY ALL), lab AS (SELECT id, count(DISTINCT label) AS nl FROM cn GROUP BY id),
mg AS (SELECT ids.*, CASE WHEN nl > 1 THEN trim(regexp_replace(lower(regexp_replace(files[1], '\\.[^./]+$', '')), '[^a-z0-9]+', '_', 'g'), '_') || '_' || id ELSE id END AS final_id, CASE WHEN nl > 1 THEN id END AS original_id FROM ids JOIN lab USING (id))"""


@query(f"WITH {MERGE_SQL} SELECT final_id, original_id, label, file_type, array_to_string(files, ',') AS source_files, seen FROM mg")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk nodes merged by identity, ids of several labels renamed."""
    merged, _ = resolve.merge_nodes(_chunk_nodes(spark, sf_dir))
    return merged.withColumn("source_files", F.array_join("source_files", ","))


@query(f"WITH {MERGE_SQL}, g AS (SELECT label, min(final_id) AS keep, count(*) AS n FROM mg GROUP BY label HAVING count(*) > 1 AND length(label) >= 8 AND NOT regexp_matches(label, '\\s') AND regexp_matches(label, '[/:@]')) SELECT mg.final_id, coalesce(n - 1, 0) AS absorbed FROM mg LEFT JOIN g USING (label) WHERE keep IS NULL OR keep = final_id")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of one global identifier folded into the least."""
    kept, _, _ = resolve.consolidate(*resolve.merge_nodes(_chunk_nodes(spark, sf_dir)))
    return kept.select("final_id", F.coalesce(F.size("consolidated_ids"), F.lit(0)).cast("long").alias("absorbed"))


@query("SELECT lpad(CAST(start + part + 1 AS VARCHAR), 4, '0') AS chunk, rn % 22 AS pos, path FROM (SELECT *, (rn // 22) AS part FROM (SELECT source || '/' || doc_id AS path, source, row_number() OVER (PARTITION BY source ORDER BY source || '/' || doc_id) - 1 AS rn FROM documents)) JOIN (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT source, (count(*) + 21) // 22 AS n FROM documents GROUP BY source)) USING (source)")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in chunks, a directory at a time."""
    files = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return gates.chunk_plan(files)


# --- retrieval ----------------------------------------------------------


@query(
    f"""
WITH e AS ({ENTRIES_SQL}), f AS (SELECT * FROM e WHERE contains(hay, 'red') AND contains(hay, 'r') ORDER BY eid LIMIT 400)
SELECT eid, CASE WHEN l = 'red r' THEN 3 ELSE 0 END + CASE WHEN starts_with(l, 'red') OR starts_with(l, 'r') THEN 2 ELSE 0 END + CASE WHEN contains(l, 'red') AND contains(l, 'r') THEN 1 ELSE 0 END AS score FROM f ORDER BY score DESC, eid LIMIT 100"""
)
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search box."""
    return retrieval.search(entries(spark, sf_dir), "red r").select("eid", "score")


def _term_sql(t: str) -> str:
    return f"""CASE WHEN l = '{t}' THEN 1000 * w_{t} WHEN starts_with(l, '{t}') THEN 100 * w_{t} ELSE 0 END"""


RANK_TERMS = ("red", "widget", "eco")
RANK_SQL = f"""
e AS ({ENTRIES_SQL}), w AS (SELECT {", ".join(f"ln(1 + count(*) / (1 + count(*) FILTER (WHERE contains(l, '{t}')))) AS w_{t}" for t in RANK_TERMS)} FROM e),
s AS (SELECT eid, community, CASE WHEN l = 'red widget eco' THEN 10000 * greatest(1, {", ".join(f"w_{t}" for t in RANK_TERMS)}) WHEN starts_with(l, 'red widget eco') THEN 1000 * greatest(1, {", ".join(f"w_{t}" for t in RANK_TERMS)}) ELSE 0 END
  + ({" + ".join(_term_sql(t) for t in RANK_TERMS)}) * power(({" + ".join(f"CASE WHEN contains(l, '{t}') THEN 1 ELSE 0 END" for t in RANK_TERMS)}) / 3, 2)
  + {" + ".join(f"CASE WHEN contains(l, '{t}') AND NOT starts_with(l, '{t}') THEN w_{t} ELSE 0 END + CASE WHEN contains(src, '{t}') THEN 0.5 * w_{t} ELSE 0 END" for t in RANK_TERMS)} AS score FROM e, w)"""


@query(f"WITH {RANK_SQL} SELECT eid, round(score, 6) AS score FROM s WHERE score > 0")
def rank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries ranked for a question."""
    return retrieval.rank_nodes(entries(spark, sf_dir), RANK_TERMS).select("eid", F.round("score", 6).alias("score"))


@query(
    f"""
WITH {RANK_SQL}, b AS (SELECT CAST(c AS BIGINT) AS community, hits FROM (VALUES (11, 4), (28, 3), (9999, 3)) t(c, hits)), r AS (SELECT eid, community, score FROM s WHERE score > 0),
inj AS (SELECT min(e.eid) AS eid, e.community, any_value(hits) * 40.0 AS score FROM e JOIN b USING (community) WHERE e.community NOT IN (SELECT community FROM r) GROUP BY e.community)
SELECT eid, round(score + coalesce(hits, 0) * 40.0, 6) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM inj) LEFT JOIN b USING (community)"""
)
def summary_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that speak of the question lift their communities."""
    prose = spark.createDataFrame([(11, "The red widget of the estate."), (28, "An ecologist's red pen."), (9999, "Widget and nothing, though eco."), (5, "Nothing of it.")], "community long, text string")
    hits = retrieval.summary_hits(prose.where("community <> 28"), RANK_TERMS).unionByName(spark.createDataFrame([(28, 3)], "community long, hits int"))
    hits = hits.withColumn("hits", F.when(F.col("community") == 9999, 3).otherwise(F.col("hits")))
    e = entries(spark, sf_dir)
    ranked = retrieval.rank_nodes(e, RANK_TERMS)
    return retrieval.boost(ranked, e, hits).select("eid", F.round("score", 6).alias("score"))


BM25_TERMS = ("attion", "nicht", "the")


@query(
    f"""
WITH h AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS x FROM documents), st AS (SELECT count(*) AS n, avg(length(x)) AS mean, {", ".join(f"count(*) FILTER (WHERE contains(x, '{t}')) AS d_{t}" for t in BM25_TERMS)} FROM h),
w AS (SELECT *, {", ".join(f"ln(1 + n / (1 + d_{t})) AS w_{t}" for t in BM25_TERMS)} FROM st), bar AS (SELECT *, 0.9 * greatest({", ".join(f"CASE WHEN d_{t} > 0 THEN w_{t} ELSE 0 END" for t in BM25_TERMS)}) AS bar FROM w),
c AS (SELECT id, 1.2 * (0.25 + 0.75 * length(x) / mean) AS norm, {", ".join(f"(length(x) - length(replace(x, '{t}', ''))) // {len(t)} AS n_{t}, w_{t}" for t in BM25_TERMS)}, bar FROM h, bar)
SELECT id, round({" + ".join(f"w_{t} * n_{t} * 2.2 / (n_{t} + norm)" for t in BM25_TERMS)}, 6) AS weight, CAST({" + ".join(f"n_{t}" for t in BM25_TERMS)} AS BIGINT) AS hits FROM c
WHERE {" OR ".join(f"(n_{t} > 0 AND w_{t} >= bar)" for t in BM25_TERMS)} ORDER BY weight DESC, hits DESC, id LIMIT 3"""
)
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts with the best evidence."""
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(X.text("text")).alias("hay"))
    return retrieval.bm25(corpus, BM25_TERMS).select("id", F.round("weight", 6).alias("weight"), "hits")


ROUTE_SQL = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{name}'" for name, p in retrieval.ROUTES)


@query(
    f"""
WITH q AS (SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'Why ' WHEN 1 THEN 'Which services ' WHEN 2 THEN 'Where is this used: ' WHEN 3 THEN 'What breaks ' WHEN 4 THEN 'Walk me through ' WHEN 5 THEN 'Who calls ' ELSE '' END || text AS text FROM benchmark)
SELECT item_id, CASE {ROUTE_SQL} ELSE 'cluster' END AS view FROM q"""
)
def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view a question asks for."""
    heads = ("Why ", "Which services ", "Where is this used: ", "What breaks ", "Walk me through ", "Who calls ")
    head = F.lit("")
    for i, h in enumerate(heads):
        head = F.when(F.col("item_id") % 8 == i, h).otherwise(head)
    return table(spark, sf_dir, "benchmark").select("item_id", retrieval.route(F.concat(head, "text")).alias("view"))


TOPIC_ROWS = [(0, "thing", ["thing", "estion"]), (1, "over", ["heer", "onen", "nicht"]), (2, "shop", ["esto", "dieein"])]
TOPIC_SQL = ", ".join(f"({pos}, '{slug}', '{k}')" for pos, slug, ks in TOPIC_ROWS for k in ks)


@query(
    f"""
WITH t AS (SELECT * FROM (VALUES {TOPIC_SQL}) v(pos, slug, k)), s AS (SELECT item_id AS qid, pos, slug, 2 * count(*) AS score FROM benchmark JOIN t ON contains(lower(text), k) GROUP BY ALL)
SELECT qid, slug, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS r FROM s) WHERE r = 1"""
)
def topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's topic."""
    topics = spark.createDataFrame(TOPIC_ROWS, "pos int, slug string, keywords array<string>")
    return retrieval.match_topics(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), topics)


ABSENT_TERMS = ("attion", "nicht", "kubernetes", "zzzz", "the")


@query(" UNION ALL ".join(f"SELECT '{t}' AS term WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), '{t}')) AND NOT EXISTS (SELECT 1 FROM conversations WHERE contains(lower(text), '{t}'))" for t in ABSENT_TERMS))
def unevidenced_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no corpus holds."""
    low = [table(spark, sf_dir, t).select(F.lower(X.text("text")).alias("hay")) for t in ("documents", "conversations")]
    return spark.createDataFrame([(t,) for t in retrieval.unevidenced(ABSENT_TERMS, *[(d, "hay") for d in low])], "term string")


STOP_SQL = ", ".join(f"'{w}'" for w in semantic.STOP)


@query(
    f"""
WITH w AS (SELECT DISTINCT doc_id, u.t AS token FROM documents, LATERAL (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,24}}')) AS t) u)
SELECT token, count(*) AS df FROM w WHERE token NOT IN ({STOP_SQL}) GROUP BY token HAVING count(*) >= 3 ORDER BY df DESC, token LIMIT 5000"""
)
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary by document frequency; the cap of 5,000 is the operator's and here small enough to bite."""
    return semantic.vocabulary(table(spark, sf_dir, "documents"), cap=5000)


@query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rk FROM p)
SELECT CAST(a AS VARCHAR) AS token, CAST(b AS VARCHAR) AS other, round(s, 3) AS score, rk AS rank FROM r WHERE rk <= 6"""
)
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of vectors by cosine, at 0.3 so that there are some."""
    out = semantic.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", least=0.3, skip_stems=False)
    return out.select("token", "other", "score", F.col("rank").cast("long").alias("rank"))


# --- gates --------------------------------------------------------------


@query("SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unsynced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is declared and not recorded."""
    return gates.unsynced(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name")))


@query("SELECT doc_id AS ticket FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)")
def outstanding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still to ask for."""
    outcome = F.when(F.col("quality") == 1, "fetched").when(F.col("toxic") == 1, "absent").otherwise("denied")
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ticket"), outcome.alias("outcome"))
    return gates.outstanding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket")), cache)


SERVICES = ["nation-service", "NATION_7_values.yaml.j2", "atio-service", "0-service", "orders-service"]
SERVICE_SQL = ", ".join(f"('{s}')" for s in SERVICES)


@query(
    rf"""
WITH s AS (SELECT s AS service, regexp_replace(lower(regexp_replace(regexp_replace(s, '_values\.ya?ml(\.j2)?$', ''), '-service$', '')), '[^a-z0-9]', '', 'g') AS stem FROM (VALUES {SERVICE_SQL}) v(s)),
r AS (SELECT DISTINCT replace(n_name, '_', '-x') || '-' || n_regionkey AS repo FROM nation UNION SELECT n_name FROM nation),
p AS (SELECT repo, regexp_replace(lower(u.p), '[^a-z0-9]', '', 'g') AS seg FROM r, LATERAL (SELECT unnest(string_split(repo, '-')) AS p) u),
x AS (SELECT service, repo FROM s JOIN p ON seg = stem), l AS (SELECT service, repo FROM s JOIN r ON length(stem) >= 4 AND contains(regexp_replace(lower(repo), '[^a-z0-9]', '', 'g'), stem) WHERE service NOT IN (SELECT service FROM x))
SELECT service, arg_min(repo, lpad(CAST(length(repo) AS VARCHAR), 6, '0') || repo) AS repo FROM (SELECT * FROM x UNION ALL SELECT * FROM l) GROUP BY service"""
)
def service_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and the repositories that hold them."""
    n = table(spark, sf_dir, "nation")
    repos = n.select(F.concat(F.replace("n_name", F.lit("_"), F.lit("-x")), F.lit("-"), "n_regionkey").alias("repo")).unionByName(n.select(F.col("n_name").alias("repo")))
    return layers.match_services(spark.createDataFrame([(s,) for s in SERVICES], "service string"), repos)


@query("SELECT doc_id AS name, substr(sha256(text), 1, 16) AS digest FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests."""
    return gates.digests(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content")))


@query("SELECT d.doc_id AS name FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0")
def digest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are no longer what was recorded; those of low quality are recorded wrong here."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), "quality"), "name")
    now = gates.digests(rows)
    then = gates.digests(rows.withColumn("content", F.when(F.col("quality") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return gates.drifted(then, now).select("name")


@query(
    """
WITH q AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ['graph', 'brief'] WHEN item_id % 3 = 1 THEN ['tickets'] ELSE ['abstain'] END AS accept, CASE WHEN item_id % 2 = 0 THEN ['graph', 'tickets'] ELSE ['dive'] END AS met FROM benchmark)
SELECT u.mode AS mode, count(*) AS declared, CAST(count(*) FILTER (WHERE list_has_any(accept, met)) AS BIGINT) AS passed, count(*) FILTER (WHERE list_has_any(accept, met)) = 0 AS floor_broken FROM q, LATERAL (SELECT unnest(accept) AS mode) u GROUP BY 1"""
)
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted modes that answers meet."""
    k = F.col("item_id") % 3
    accept = F.when(k == 0, F.array(F.lit("graph"), F.lit("brief"))).when(k == 1, F.array(F.lit("tickets"))).otherwise(F.array(F.lit("abstain")))
    met = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("graph"), F.lit("tickets"))).otherwise(F.array(F.lit("dive")))
    return retrieval.gate(table(spark, sf_dir, "benchmark").select(accept.alias("accept"), met.alias("met")))


@query(
    r"""
WITH p AS (SELECT p_partkey AS k, 'The FooWidget' || (p_partkey % 4) || ' calls ' || replace(p_name, ' ', '_') || ' and file-' || (p_partkey % 3) || '-x in main_' || (p_partkey % 5) || '.py' AS t FROM part),
c AS (SELECT DISTINCT k, regexp_replace(lower(u.i), '[^a-z0-9]', '', 'g') AS n FROM p, LATERAL (SELECT unnest(list_concat(regexp_extract_all(t, '\bFooWidget\d\b'), regexp_extract_all(t, '\b[a-z]+_[a-z0-9]+\b'), regexp_extract_all(t, '\bfile-\d-x\b'), regexp_extract_all(t, '\bmain_\d\.py\b'))) AS i) u),
e AS (SELECT p_partkey AS k, regexp_replace(lower(u.i), '[^a-z0-9]', '', 'g') AS n FROM part, LATERAL (SELECT unnest([replace(p_name, ' ', '_'), 'FooWidget1', 'main_2.py', 'main_2']) AS i) u)
SELECT c.k AS community, c.n AS norm FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = c.k AND e.n = c.n)"""
)
def grounding_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of prose that its evidence doesn't hold."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    key = F.col("p_partkey")
    prose = p.select(key.alias("community"), F.concat(F.lit("The FooWidget"), key % 4, F.lit(" calls "), name, F.lit(" and file-"), key % 3, F.lit("-x in main_"), key % 5, F.lit(".py")).alias("text"))
    evidence = p.select(key.alias("community"), F.explode(F.array(name, F.lit("FooWidget1"), F.lit("main_2.py"))).alias("identifier"))
    return dossier.ungrounded(prose, evidence).select("community", dossier.normalised(F.col("identifier")).alias("norm")).distinct()


@query("SELECT p_partkey AS path, rank FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 12")
def top_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve nodes a repository."""
    return dossier.top_per_group(table(spark, sf_dir, "part"), "p_brand", 12, F.desc("p_size"), "p_partkey").select(F.col("p_partkey").alias("path"), F.col("rn").cast("long").alias("rank"))

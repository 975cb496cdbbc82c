"""More registered queries: parsers on contents made from the tables' rows, predicates, and parts of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dossier, gates, graph, history, intent, layers, resolve, retrieval
from ..sources import discovery, parsers, tracker
from . import reports
from .catalogue import BFS_SQL, MERGE_SQL, _chunk_nodes, query
from .standins import INDEX_SQL, LINKS_SQL, NODES_SQL, entries, index, links, nodes, table


def made(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """Rows that a Spark SQL projection makes from one table."""
    return table(spark, sf_dir, name).selectExpr(*sql.split(" ;; "))


@query("SELECT p_partkey AS k, 'f' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS additions, CAST(p_partkey % 9 AS BIGINT) AS deletions, p_partkey % 4 = 0 AS binary FROM part")
def numstat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics of commits; a null count shows as -1."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; array(concat_ws('\\t', if(p_partkey % 4 = 0, '-', cast(p_size AS string)), p_partkey % 9, concat('f', p_partkey)), 'not a stat') AS l")
    return rows.select("k", F.explode(parsers.numstat(F.col("l"))).alias("f")).select("k", "f.path", F.coalesce(F.col("f.additions").cast("int"), F.lit(-1)).alias("additions"), "f.deletions", "f.binary")


LOG_SQL = "concat(chr(30), concat_ws(chr(31), lpad(o_orderkey, 40, '0'), if(o_orderkey % 5 = 0, 'p1 p2', 'p1'), 'Ann', 'a@x', cast(o_orderdate AS string), 'Bob', 'b@x', cast(o_orderdate AS string), '', concat('AB-', o_orderkey % 7, ' ', o_orderpriority), concat('Line\\r\\n\\n\\n\\n', o_orderstatus)), chr(29), '\\n3\\t', o_orderkey % 4, '\\ta.py\\n')"


@query("SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS is_merge, 'AB-' || (o_orderkey % 7) || ' ' || o_orderpriority AS subject, 'Line' || chr(10) || chr(10) || o_orderstatus AS body, 3 AS additions, o_orderkey % 4 AS deletions FROM orders")
def git_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured logs as commits."""
    logs = made(spark, sf_dir, "orders", f"o_orderkey AS repository ;; '' AS repository_url ;; {LOG_SQL} AS log")
    commits, _ = parsers.parse_git_log(logs)
    return commits.select(F.col("repository").alias("k"), "is_merge", "subject", "body", F.col("additions").cast("int").alias("additions"), "deletions")


@query("SELECT p_partkey AS k, 'Pay ' || p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE '(root)' END AS area, 1 + p_partkey % 2 AS scenarios, 'i buy ¤ ' || p_name AS step, CASE WHEN p_partkey % 3 = 0 THEN 'AB-' || (p_partkey % 10) ELSE '' END AS tickets FROM part")
def gherkin_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature files."""
    content = "concat(if(p_partkey % 3 = 0, concat('@smoke @AB-', p_partkey % 10, '\\n'), ''), 'Feature: Pay ', p_name, '\\n  Scenario: one\\n    Given I buy 12 ', p_name, '\\n', if(p_partkey % 2 = 1, '  Scenario Outline: two\\n', ''), '    | a table |\\n')"
    files = made(spark, sf_dir, "part", f"cast(p_partkey AS string) AS repo ;; if(p_partkey % 2 = 0, concat('x/features/', lower(p_type), '/a.feature'), 'a.feature') AS path ;; {content} AS content")
    out = parsers.parse_features(files)
    return out.select(F.col("repo").cast("long").alias("k"), "name", "area", F.size("scenarios").cast("long").alias("scenarios"), F.array_join("steps", ",").alias("step"), F.array_join("tickets", ",").alias("tickets"))


@query("SELECT DISTINCT lower(p_brand) AS consumer, 'mod-' || (p_partkey % 11) AS provider FROM part WHERE lower(p_brand) <> 'mod-' || (p_partkey % 11)")
def module_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terraform modules that repositories use."""
    forms = "CASE p_partkey % 4 WHEN 0 THEN concat('git::https://github.com/o/mod-', p_partkey % 11, '.git?ref=1') WHEN 1 THEN concat('git@github.com:o/mod-', p_partkey % 11, '.git') WHEN 2 THEN concat('github.com/o/mod-', p_partkey % 11) ELSE concat('git::ssh://git@github.com/o/mod-', p_partkey % 11, '//sub') END"
    files = made(spark, sf_dir, "part", f"lower(p_brand) AS repo ;; concat('m', p_partkey, '.tf') AS path ;; concat('module \"a\" {{ source = \"', {forms}, '\" }} module \"b\" {{ source = \"notgithub.com/o/x\" }}') AS content".replace("{{", "{").replace("}}", "}"))
    return parsers.module_references(files).select("consumer", "provider")


@query(
    """
SELECT c.repo AS consumer, p.repo AS provider, p.package AS package FROM (SELECT DISTINCT 'app-' || c_nationkey AS repo, '@org/lib' || (c_nationkey % 7) AS package FROM customer) c
JOIN (SELECT DISTINCT 'lib-' || s_nationkey AS repo, '@org/lib' || s_nationkey AS package FROM supplier) p ON c.package = p.package WHERE c.repo <> p.repo"""
)
def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that repositories share."""
    app = made(spark, sf_dir, "customer", "concat('app-', c_nationkey) AS repo ;; 'package.json' AS path ;; concat('{\"dependencies\": {\"@org/lib', c_nationkey % 7, '\": \"1\"}}') AS content").distinct()
    lib = made(spark, sf_dir, "supplier", "concat('lib-', s_nationkey) AS repo ;; 'package.json' AS path ;; concat('{\"name\": \"@org/lib', s_nationkey, '\"}') AS content").distinct()
    packages, deps = parsers.parse_manifests(app.unionByName(lib))
    none = spark.createDataFrame([], "repo string, package string, path string")
    made_nodes, _ = layers.package_layer(packages, deps, none, spark.createDataFrame([], "repo string, source_file string, id string"))
    return made_nodes.select(F.col("repo").alias("provider"), F.col("label").alias("package"), F.explode("consumers.repo").alias("consumer"))


@query("SELECT DISTINCT 'r' AS repo, '@org/p' || (p_partkey % 13) AS package, 'src/f' || p_partkey || '.ts' AS path FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 13 < 9")
def import_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that import known packages."""
    line = "CASE p_partkey % 3 WHEN 0 THEN concat('import a from \"@org/p', p_partkey % 13, '/deep\";') WHEN 1 THEN concat('const b = require(''@org/p', p_partkey % 13, ''')') ELSE concat('// see @org/p', p_partkey % 13) END"
    files = made(spark, sf_dir, "part", f"'r' AS repo ;; concat('src/f', p_partkey, '.ts') AS path ;; {line} AS content")
    known = spark.createDataFrame([(f"@org/p{i}",) for i in range(9)], "package string")
    return parsers.import_sites(files, known)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '_base' ELSE lower(p_type) END AS environment, 'svc-' || (p_partkey % 17) AS service, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'a.b=<set-at-deploy-time>, a.c.0=' || p_size || ', d=' END AS config FROM part")
def deploy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration of deployed services."""
    content = "if(p_partkey % 5 = 0, '- a list', concat('{% if x %}\\na:\\n  b: {{ secret }}\\n  c: [', p_size, ']\\n{% endif %}\\nd: null\\n'))"
    files = made(spark, sf_dir, "part", f"cast(p_partkey AS string) AS repo ;; concat('vars/', if(p_partkey % 3 = 0, '', concat(lower(p_type), '/')), 'svc-', p_partkey % 17, '_values.yaml.j2') AS path ;; {content} AS content")
    out = parsers.parse_values(files, "vars")
    return out.select(F.col("repo").cast("long").alias("k"), "environment", "service", F.when(F.col("config").isNotNull(), X.deployment_summary(F.col("config"))).alias("config"))


@query("SELECT n_name || '-' || n_regionkey AS name, CASE WHEN n_name = 'NATION_3' THEN 'external' ELSE 'estate' END AS place FROM nation WHERE (n_name LIKE 'NATION_1%' OR n_name = 'NATION_3' OR n_name LIKE 'NATION__' AND n_regionkey = 2) AND n_name <> 'NATION_12'")
def repository_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that rules select."""
    rows = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("-"), "n_regionkey").alias("name"), F.lit("main").alias("defaultBranch"))
    names = {r["name"].rsplit("-", 1)[0]: r["name"] for r in rows.collect()}
    rules = [("prefix", "NATION_1"), ("match", "NATION_?-2"), ("fetch", names["NATION_3"]), ("exclude", names["NATION_12"])]
    listing = "\n".join(rows.toJSON().collect())
    return discovery.discover(spark, rules, "o", lambda args: listing).select("name", "place")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'src/' || p_partkey || '/a.py' WHEN p_partkey % 3 = 1 THEN 'x/unit-tests/a.csv' ELSE 'x/wiremock/a.csv' END AS path, p_partkey % 3 <> 0 AS fixture FROM part")
def fixture_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths of fixtures."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 3 WHEN 0 THEN concat('src/', p_partkey, '/a.py') WHEN 1 THEN 'x/unit-tests/a.csv' ELSE 'x/wiremock/a.csv' END AS path")
    return rows.withColumn("fixture", gates.is_fixture_path(F.col("path")))


@query("SELECT 'pkg/F' || p_partkey || '.java' AS path, 'pkg/t/F' || p_partkey || 'Test.java' AS test FROM part WHERE p_partkey % 4 = 1")
def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files and their tests."""
    files = made(spark, sf_dir, "part", "explode(if(p_partkey % 4 = 1, array(concat('pkg/F', p_partkey, '.java'), concat('pkg/t/F', p_partkey, 'Test.java')), array(concat('pkg/F', p_partkey, '.java')))) AS path")
    return history.test_pairs(files)


@query("SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS automated FROM orders")
def automated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identities that are machines."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; CASE WHEN o_orderkey % 6 = 0 THEN 'some[bot]' WHEN o_orderkey % 6 = 3 THEN 'CI Jenkins' ELSE 'Jenkinson' END AS n ;; 'x@renovate.org' AS e")
    return rows.select("k", X.is_automated(F.col("n"), F.col("e")).alias("automated"))


@query("SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 1) AS junk FROM orders")
def junk_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """descriptions that say nothing."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; CASE o_orderkey % 4 WHEN 0 THEN 'Merge branch a into b' WHEN 1 THEN 'short' ELSE concat('A real description of ', o_orderpriority) END AS d")
    return rows.select("k", X.is_junk_description(F.col("d")).alias("junk"))


@query("SELECT o_custkey % 50 AS author, year, n FROM (SELECT o_custkey % 50 AS o_custkey, substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year, count(*) AS n FROM orders GROUP BY 1, 2)")
def commits_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits by repository and year."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("repository"), F.col("o_orderdate").cast("string").alias("author_date"))
    return history.commits_by_year(rows).withColumnRenamed("repository", "author")


@query("SELECT repository, author, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, lower(author), author) AS rank FROM (SELECT o_orderpriority AS repository, 'C' || (o_custkey % 200) AS author, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE rank <= 20")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's most frequent authors."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repository"), F.struct(F.concat(F.lit("C"), F.col("o_custkey") % 200).alias("name")).alias("author"))
    return history.authors(rows).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""
WITH {MERGE_SQL}, rm AS (SELECT chunk, cn.id, max_by(final_id, cn.label || '|' || cn.file_type) AS final_id FROM cn JOIN mg ON cn.id = mg.id AND cn.label = mg.label AND cn.file_type = mg.file_type GROUP BY chunk, cn.id),
g AS (SELECT id, count(DISTINCT final_id) AS n, min(final_id) AS only FROM rm GROUP BY id), e AS (SELECT 'c' || (p_partkey % 5) AS chunk, 'n' || (p_partkey % 300) AS s, CASE WHEN p_partkey % 2 = 0 THEN 'svc_' || (p_partkey % 30) ELSE 'n' || (p_partkey % 290) END AS t FROM part),
x AS (SELECT CASE WHEN a.final_id IS NOT NULL THEN 'own' WHEN ga.n = 1 THEN 'recovered' WHEN ga.n > 1 THEN 'ambiguous' ELSE 'dangling' END AS ss, CASE WHEN b.final_id IS NOT NULL THEN 'own' WHEN gb.n = 1 THEN 'recovered' WHEN gb.n > 1 THEN 'ambiguous' ELSE 'dangling' END AS ts
  FROM e LEFT JOIN rm a ON a.chunk = e.chunk AND a.id = e.s LEFT JOIN rm b ON b.chunk = e.chunk AND b.id = e.t LEFT JOIN g ga ON ga.id = e.s LEFT JOIN g gb ON gb.id = e.t)
SELECT state, count(*) AS n FROM (SELECT ss AS state FROM x UNION ALL SELECT ts FROM x) WHERE state <> 'own' GROUP BY state"""
)
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How ends of chunk edges resolve."""
    _, remap = resolve.merge_nodes(_chunk_nodes(spark, sf_dir))
    edges = made(spark, sf_dir, "part", "concat('c', p_partkey % 5) AS chunk ;; p_partkey AS pos ;; concat('n', p_partkey % 300) AS source ;; if(p_partkey % 2 = 0, concat('svc_', p_partkey % 30), concat('n', p_partkey % 290)) AS target ;; 'r' AS relation")
    _, counts = resolve.resolve_edges(edges, remap)
    return counts.where("state <> 'duplicate'")


@query("SELECT p_partkey AS k, length(trim(l)) >= 8 AND NOT regexp_matches(trim(l), '\\s') AND regexp_matches(l, '[/:@]') AS is_global FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'host/' || replace(p_name, ' ', '-') WHEN 2 THEN 'deployment' ELSE 'a@b' END AS l FROM part)")
def global_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels that name one thing anywhere."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('host/', replace(p_name, ' ', '-')) WHEN 2 THEN 'deployment' ELSE 'a@b' END AS l")
    return rows.select("k", resolve.is_global_identifier(F.col("l")).alias("is_global"))


@query(f"WITH n AS ({NODES_SQL}) SELECT count(*) AS nodes, count(DISTINCT community) AS communities, count(community) AS clustered FROM n")
def clustering_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and communities."""
    return graph.clustering_counts(nodes(spark, sf_dir))


@query(f"WITH n AS ({NODES_SQL}) SELECT count(*) FILTER (WHERE repo = 'Brand#3') AS nodes, round(count(*) FILTER (WHERE repo = 'Brand#3') / count(*), 6) AS share, count(DISTINCT CASE WHEN repo = 'Brand#3' THEN community END) AS communities FROM n")
def repo_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's share of the graph."""
    return history.scale(nodes(spark, sf_dir), "Brand#3").withColumn("share", F.round("share", 6))


@query(f"WITH n AS ({NODES_SQL}) SELECT repo, source_file, min(id) AS id FROM n GROUP BY ALL")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each file."""
    return graph.representatives(nodes(spark, sf_dir), "repo", "source_file")


@query("SELECT l_suppkey AS id, array_to_string(list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))), ',') AS tickets FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 3) GROUP BY 1")
def features_of_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose tickets touch a repository."""
    li = table(spark, sf_dir, "lineitem")
    feats = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.col("l_orderkey").cast("string")).alias("tickets")).withColumn("label", F.lit("f"))
    ix = li.select(F.col("l_partkey").cast("string").alias("repo"), F.col("l_orderkey").cast("string").alias("ticket"))
    return history.features_of(feats, ix, "3").select("id", F.array_join("tickets", ",").alias("tickets"))


@query("SELECT user_id AS ticket, CASE WHEN bool_or(event_type <> 'error') THEN 'fetched' ELSE 'denied' END AS outcome FROM events GROUP BY 1")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes folded into a cache, denied ones never over final ones."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticket"), F.when(F.col("event_type") == "error", "denied").otherwise("fetched").alias("outcome"))
    half = F.xxhash64("ticket", "outcome") % 2 == 0
    return tracker.upsert(e.where(half), e.where(~half))


@query("SELECT l_orderkey AS ticket, (row_number() OVER (ORDER BY l_orderkey) - 1) // 100 AS page FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def ticket_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in pages of a hundred."""
    return gates.pages_of(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket")), 100)


@query(f"WITH {BFS_SQL}, t AS (SELECT node, dist, CAST(substr(node, 2) AS BIGINT) % 40 AS ticket FROM reach) SELECT ticket, CAST(sum(2 - dist) AS BIGINT) AS weight FROM t GROUP BY ticket")
def weighted_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of a reached set, by nearness."""
    edges = graph.both_ways(links(spark, sf_dir))
    reached = graph.bfs(edges, spark.createDataFrame([("p7",)], "node string"), 2).withColumnRenamed("node", "eid")
    own = nodes(spark, sf_dir).select(F.col("id").alias("eid"), F.array(F.substring("id", 2, 20).cast("long") % 40).alias("tickets"))
    return retrieval.weighted_tickets(reached, own)


@query("SELECT doc_id AS community, CASE WHEN doc_id % 7 = 0 THEN 'unknown-id' WHEN length(trim(text)) < 60 THEN 'too-short' WHEN length(trim(text)) > 700 THEN 'too-long' ELSE '' END AS reason FROM documents")
def prose_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose that may be merged."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("community"), "text")
    return dossier.prose_gate(d, d.where("community % 7 <> 0"), 60, 700).select("community", "reason")


@query("SELECT item_id AS community, 'may be' AS word FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 'probably' FROM benchmark WHERE item_id % 5 = 0")
def speculation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of speculation."""
    rows = made(spark, sf_dir, "benchmark", "item_id AS community ;; concat(if(item_id % 3 = 0, 'It May be so. ', ''), if(item_id % 5 = 0, 'Probably not, improbably. ', ''), 'x') AS text")
    return dossier.speculation(rows)


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN '.tf' ELSE '.xyz' END AS suffix, count(*) AS n FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1")
def missing_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffixes that nothing extracts."""
    return gates.suffix_counts(made(spark, sf_dir, "part", "concat('d.x/f', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.TF' WHEN 1 THEN '.py' ELSE '.xyz' END) AS path"), (".py",))


@query("SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS kept FROM orders")
def comment_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that automation wrote."""
    rows = made(spark, sf_dir, "orders", "o_orderkey AS k ;; array(if(o_orderkey % 3 = 0, 'Build failed in Jenkins', 'A person said so')) AS comments")
    issues = rows.select(F.col("k").cast("string").alias("ticket"), *[F.lit(None).cast("string").alias(c) for c in "summary type status resolution created resolved parent description".split()], "comments")
    return tracker.projected(issues).select(F.col("ticket").cast("long").alias("k"), F.col("comments").isNotNull().alias("kept"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'csv' ELSE 'mined' END AS title FROM part")
def ticket_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ticket is called, by source."""
    rows = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    return rows.select(F.col("p_partkey").alias("k"), reports.ticket_detail(F.when(k == 0, F.col("p_name")).otherwise(""), F.when(k == 1, "csv"), F.array(F.lit("mined"))).alias("title"))


@query(f"WITH x AS ({INDEX_SQL}) SELECT path, count(DISTINCT ticket) AS tickets FROM x GROUP BY path ORDER BY tickets DESC, path LIMIT 15")
def churn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by tickets."""
    return history.top(history.churn(index(spark, sf_dir), "path"), 15, F.desc("tickets"), "path")


@query("SELECT p_partkey AS ticket, arg_max(v, i) AS title FROM (SELECT p_partkey, p_name AS v, -1 AS i FROM part UNION ALL SELECT s_suppkey % 500, s_name, s_suppkey FROM supplier) GROUP BY 1")
def title_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, the last import wins."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticket"), F.col("p_name").alias("title"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 500).alias("ticket"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("pos"))
    return intent.upsert_titles(old, new)


@query("SELECT community, eid AS first FROM (SELECT community, min(eid) AS eid FROM (SELECT p_partkey AS eid, CAST(p_size AS BIGINT) AS community FROM part WHERE p_name LIKE 'red%') GROUP BY 1) WHERE community % 2 = 0 ORDER BY eid LIMIT 4")
def summaries_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: prose of the first communities of an answer."""
    prose = spark.range(0, 100, 2).select(F.col("id").alias("community"), F.lit("p").alias("text"))
    return reports.summaries_for(entries(spark, sf_dir).where("label LIKE 'red%'"), prose, "eid", 4).select("community", "first")


@query(f"SELECT label_lower FROM (SELECT lower(a.label) AS label_lower FROM ({LINKS_SQL}) l JOIN ({NODES_SQL}) a ON l.source = a.id JOIN ({NODES_SQL}) b ON l.target = b.id WHERE lower(a.label) = lower(b.label) AND a.repo <> b.repo) GROUP BY 1")
def connected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of which two repositories' nodes are linked."""
    return graph.connected_labels(nodes(spark, sf_dir), links(spark, sf_dir))

"""Registered queries of layers, dossiers, dives, gates and sources, over rows made from the tables.

Every query reads its tables whole. Where an operator sets one input against another (services with a repository, files in a
cache), the second is made so that some rows have no partner.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossier, gates, graph, history, layers, resolve, retrieval, semantic, status
from ..operators.shared import new_folder
from ..settings import DEFAULTS, STEP_LANGUAGES
from ..sources import discovery, parsers, readers, sinks, sync, tracker
from ..sources.schemas import L, S, struct
from . import reports
from .catalogue import BFS_SQL, DEGREE_SQL, query
from .catalogue_more import LOG_SQL, made
from .standins import ENTRIES_SQL, INDEX_SQL, LINKS_SQL, NODES_SQL, entries, index, links, nodes, table


def norm_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


# --- layers -------------------------------------------------------------

FEATURES_SQL = f"""
f AS (SELECT p_partkey AS k, 'r' || (p_partkey % 3) AS repo, 'x/features/t' || (p_partkey % 5) || '/F ' || p_partkey || '.feature' AS path, p_name AS name, 't' || (p_partkey % 5) AS area, {norm_sql("'r' || (p_partkey % 3) || '_x/features/t' || (p_partkey % 5) || '/F ' || p_partkey || '.feature'")} AS fid FROM part),
st AS (SELECT DISTINCT 'r' || (s_suppkey % 3) AS repo, s_suppkey % 7 AS s FROM supplier), top AS (SELECT max(s) AS m FROM st), ar AS (SELECT area, m + dense_rank() OVER (ORDER BY area) AS community FROM (SELECT DISTINCT area FROM f), top)"""


def _gherkin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = "p_partkey"
    feature = f"concat('r', {k} % 3) AS repo ;; concat('x/features/t', {k} % 5, '/F ', {k}, '.feature') AS path ;; p_name AS name ;; concat('t', {k} % 5) AS area ;; if({k} % 2 = 0, array('one', 'two'), array('one')) AS scenarios ;; array(concat('i buy ¤ ', {k} % 7), 'i go') AS steps ;; if({k} % 3 = 0, array(concat('AB-', {k} % 10)), CAST(array() AS array<string>)) AS tickets"
    step = "concat('r', s_suppkey % 3) AS repo ;; concat('i buy ¤ ', s_suppkey % 7) AS step ;; concat('S', s_suppkey % 7) AS symbol ;; concat('src/S', s_suppkey % 7, '.java') AS path"
    node = "concat('n', s_suppkey % 3, '_', s_suppkey % 7) AS id ;; concat('r', s_suppkey % 3) AS repo ;; concat('src/S', s_suppkey % 7, '.java') AS source_file ;; concat('S', s_suppkey % 7) AS label ;; s_suppkey % 7 AS community"
    return layers.gherkin_layer(made(spark, sf_dir, "part", feature), made(spark, sf_dir, "supplier", step).distinct(), made(spark, sf_dir, "supplier", node).distinct())


@query(
    f"""
WITH {FEATURES_SQL}, x AS (SELECT f.*, community FROM f JOIN ar USING (area))
SELECT fid AS id, name AS label, repo, path AS source_file, community, 'feature' AS kind FROM x
UNION ALL SELECT fid || '_s' || i, CASE i WHEN 0 THEN 'one' ELSE 'two' END, repo, path, community, 'scenario' FROM x, (VALUES (0), (1)) v(i) WHERE i = 0 OR k % 2 = 0
UNION ALL SELECT DISTINCT 'ticket_ab_' || (k % 10), 'AB-' || (k % 10), '', NULL, -1, 'ticket' FROM x WHERE k % 3 = 0"""
)
def feature_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, scenarios and tickets as nodes, a community an area."""
    return _gherkin(spark, sf_dir)[0].select("id", "label", "repo", "source_file", F.coalesce("community", F.lit(-1)).alias("community"), "kind")


@query(
    f"""
WITH {FEATURES_SQL}
SELECT fid AS source, fid || '_s' || i AS target, 'has_scenario' AS relation, path AS file FROM f, (VALUES (0), (1)) v(i) WHERE i = 0 OR k % 2 = 0
UNION ALL SELECT fid, 'ticket_ab_' || (k % 10), 'references', path FROM f WHERE k % 3 = 0
UNION ALL SELECT fid, 'n' || substr(f.repo, 2) || '_' || s, 'implemented_by', 'src/S' || s || '.java' FROM f JOIN st ON f.repo = st.repo AND f.k % 7 = s"""
)
def feature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features to scenarios, tickets and the classes of their steps."""
    return _gherkin(spark, sf_dir)[1].select("source", "target", "relation", F.col("source_file").alias("file"))


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    packages = made(spark, sf_dir, "supplier", "concat('lib-', s_suppkey % 5) AS repo ;; concat('@org/p', s_suppkey % 5) AS package").distinct()
    uses = made(spark, sf_dir, "customer", "concat(if(c_custkey % 9 = 0, 'lib-', 'app-'), c_custkey % 4) AS repo ;; concat('@org/p', c_custkey % 6) AS package").distinct()
    imports = made(spark, sf_dir, "part", "concat('app-', p_partkey % 4) AS repo ;; concat('@org/p', p_partkey % 6) AS package ;; concat('src/f', p_partkey, '.ts') AS path")
    reps = made(spark, sf_dir, "part", "concat('app-', p_partkey % 4) AS repo ;; concat('src/f', p_partkey, '.ts') AS source_file ;; concat('n', p_partkey) AS id").where("substring(id, 2) % 2 = 0")
    return layers.package_layer(packages, uses, imports, reps)


PACKAGES_SQL = """
p AS (SELECT DISTINCT 'lib-' || (s_suppkey % 5) AS provider, '@org/p' || (s_suppkey % 5) AS package FROM supplier), d AS (SELECT DISTINCT CASE WHEN c_custkey % 9 = 0 THEN 'lib-' ELSE 'app-' END || (c_custkey % 4) AS consumer, '@org/p' || (c_custkey % 6) AS package FROM customer),
u AS (SELECT consumer, provider, package FROM d JOIN p USING (package) WHERE consumer <> provider), i AS (SELECT 'app-' || (p_partkey % 4) AS consumer, '@org/p' || (p_partkey % 6) AS package, 'src/f' || p_partkey || '.ts' AS path, p_partkey AS k FROM part)"""


@query(f"WITH {PACKAGES_SQL} SELECT provider, package, consumer, count(k) AS import_sites FROM u LEFT JOIN i USING (consumer, package) GROUP BY ALL")
def package_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who depends on a package, and in how many files."""
    rows = _packages(spark, sf_dir)[0].select(F.col("repo").alias("provider"), F.col("label").alias("package"), F.explode("consumers").alias("c"))
    return rows.select("provider", "package", F.col("c.repo").alias("consumer"), F.col("c.import_sites").alias("import_sites"))


@query(f"WITH {PACKAGES_SQL}, x AS (SELECT 'n' || k AS source, provider || '::' || package AS target, path, row_number() OVER (PARTITION BY consumer, provider, package ORDER BY path) AS rn FROM i JOIN u USING (consumer, package) WHERE k % 2 = 0) SELECT source, target, path FROM x WHERE rn <= 5")
def package_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer's first five importing files that have a node."""
    return _packages(spark, sf_dir)[1].select("source", "target", F.col("source_file").alias("path"))


@query("SELECT 'r' || (p_partkey % 4) AS repo, '@org/p' || g AS package, min('n' || p_partkey) AS id FROM part, (VALUES (0), (1), (2)) v(g) WHERE starts_with('packages/p' || (p_partkey % 3) || '/f' || p_partkey || '.ts', 'packages/p' || g || '/') GROUP BY ALL")
def package_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least node below a package's folder."""
    own = made(spark, sf_dir, "part", "concat('r', p_partkey % 4) AS repo ;; concat('packages/p', p_partkey % 3, '/f', p_partkey, '.ts') AS source_file ;; concat('n', p_partkey) AS id")
    packages = own.select("repo").distinct().select("repo", F.explode(F.array(*[F.struct(F.lit(f"@org/p{i}").alias("package"), F.lit(f"packages/p{i}/").alias("prefix")) for i in range(4)])).alias("p")).select("repo", "p.*")
    return layers.anchors_under(own, packages)


@query(
    """
WITH x AS (SELECT DISTINCT 'r' || (p_partkey % 4) AS consumer, p_partkey % 6 AS m, 'm' || p_partkey || '.tf' AS file FROM part), l AS (SELECT *, row_number() OVER (PARTITION BY consumer, m ORDER BY file) AS rn FROM x)
SELECT 'node' AS part, 'mod-' || m || '::module' AS a, CASE WHEN m < 3 THEN 'mod-' || m ELSE '' END AS b, CAST(m < 3 AS VARCHAR) AS c FROM (SELECT DISTINCT m FROM x)
UNION ALL SELECT 'link', 'n-' || consumer, 'mod-' || m || '::module', file FROM l WHERE rn <= 5 AND consumer <> 'r3'"""
)
def terraform_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terraform modules; those outside the estate have no repository."""
    refs = made(spark, sf_dir, "part", "concat('r', p_partkey % 4) AS consumer ;; concat('mod-', p_partkey % 6) AS provider ;; concat('m', p_partkey, '.tf') AS f").groupBy("consumer", "provider").agg(F.array_sort(F.collect_set("f")).alias("files"))
    estate = spark.createDataFrame([(f"mod-{i}",) for i in range(3)], "name string")
    repos = spark.createDataFrame([(f"r{i}", f"n-r{i}") for i in range(3)], "repo string, id string")
    found, uses = layers.module_layer(refs, estate, repos)
    return found.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("repo").alias("b"), F.col("in_estate").cast("string").alias("c")).unionByName(uses.select(F.lit("link").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("source_file").alias("c")))


def _deployments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    values = made(spark, sf_dir, "supplier", "concat('e', s_suppkey % 3) AS environment ;; concat('svc-', s_suppkey) AS service ;; concat('vars/', s_suppkey) AS path ;; if(s_suppkey % 5 = 0, NULL, map('k', cast(s_suppkey AS string))) AS config")
    matched = made(spark, sf_dir, "supplier", "concat('svc-', s_suppkey) AS service ;; concat('repo-', s_suppkey % 4) AS repo").where("substring(service, 5) % 2 = 0")
    own = made(spark, sf_dir, "part", "concat('p', p_partkey) AS id ;; p_size AS community")
    return values, matched, own


DEPLOY_SQL = "v AS (SELECT s_suppkey AS s, s_suppkey % 3 AS e, CASE WHEN s_suppkey % 2 = 0 THEN 'repo-' || (s_suppkey % 4) END AS repo FROM supplier WHERE s_suppkey % 5 <> 0), en AS (SELECT e, (SELECT max(p_size) FROM part) + dense_rank() OVER (ORDER BY 'e' || e) AS community FROM (SELECT DISTINCT e FROM v))"


@query(f"WITH {DEPLOY_SQL} SELECT 'env_e' || e AS id, 'e' || e AS label, community, NULL AS repo FROM en UNION ALL SELECT 'deploy_e' || e || '_svc_' || s, 'svc-' || s || ' (e' || e || ')', community, repo FROM v JOIN en USING (e)")
def deployment_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments and the services in them, a community an environment."""
    values, matched, own = _deployments(spark, sf_dir)
    found, _ = layers.deployment_layer(values, matched, own, spark.createDataFrame([], "repo string, id string"))
    return found.select("id", "label", F.col("community").cast("long").alias("community"), "repo")


@query(f"WITH {DEPLOY_SQL} SELECT 'deploy_e' || e || '_svc_' || s AS source, 'env_e' || e AS target, 'deployed_to' AS relation FROM v UNION ALL SELECT 'deploy_e' || e || '_svc_' || s, 'anchor', 'configures' FROM v WHERE repo = 'repo-2'")
def deployment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services to their environments and repositories."""
    values, matched, own = _deployments(spark, sf_dir)
    _, found = layers.deployment_layer(values, matched, own, spark.createDataFrame([("repo-2", "anchor")], "repo string, id string"))
    return found.select("source", "target", "relation")


@query("SELECT count(*) AS services, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS matched FROM supplier")
def deployment_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that a repository is known of."""
    values, matched, _ = _deployments(spark, sf_dir)
    return layers.join_rate(values, matched)


@query("SELECT 'r' || (p_partkey % 3) AS repo, 'i buy ¤ ' || (p_partkey % 11) AS step, max_by(symbol, ord) AS symbol FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE 'f' || p_partkey END AS symbol, CASE WHEN p_partkey % 2 = 0 THEN '0src/test/java/a/F' || p_partkey || '.java' ELSE '1steps/f' || p_partkey || '.py' END AS ord FROM part) GROUP BY ALL")
def step_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step definitions of two languages, the later language and file first."""
    content = "if(p_partkey % 2 = 0, concat('public class S', p_partkey, ' { @When(\"I buy {int} ', p_partkey % 11, '\") void a() {} }'), concat('@when(''I buy {n:d} ', p_partkey % 11, ''')'))"
    # numbers in step texts are parameters too, so that the last one is spelled
    content = content.replace("p_partkey % 11, '", "element_at(array('zero','one','two','three','four','five','six','seven','eight','nine','ten'), cast(p_partkey % 11 + 1 AS int)), '")
    files = made(spark, sf_dir, "part", f"concat('r', p_partkey % 3) AS repo ;; if(p_partkey % 2 = 0, concat('src/test/java/a/F', p_partkey, '.java'), concat('steps/f', p_partkey, '.py')) AS path ;; {content} AS content")
    names = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    spelled = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, str(i))])
    steps = parsers.parse_steps(files, STEP_LANGUAGES)
    return steps.select("repo", F.concat(F.lit("i buy ¤ "), F.element_at(spelled, F.regexp_extract("step", r"(\w+)$", 1))).alias("step"), "symbol")


# --- dossiers and dives -------------------------------------------------

TOPICS = [("red", ["red", "azure"]), ("eco", ["eco"])]
TOPIC_SQL = f"tp AS (SELECT * FROM (VALUES {', '.join(f'({s!r}, {k!r})' for s, ks in TOPICS for k in ks)}) v(slug, w)), m AS (SELECT DISTINCT slug, n.* FROM ({NODES_SQL}) n JOIN tp ON contains(lower(coalesce(label, '') || ' ' || coalesce(source_file, '')), w))"


def _dossier(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    own, ends = nodes(spark, sf_dir), links(spark, sf_dir)
    own = own.withColumn("kind", F.when(F.col("id").startswith("s") & (F.substring("id", 2, 20).cast("long") % 3 == 1), "ticket").otherwise(F.when(F.col("id").startswith("p") & (F.col("pos") % 4 == 0), "feature").otherwise(F.col("kind"))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("community"), F.col("text"))
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticket"), F.array("p_name", "p_type").alias("d"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("repos"))
    return dossier.topic_dossier(own, ends, graph.degree(ends), spark.createDataFrame(TOPICS, "slug string, keywords array<string>"), docs, records)


@query(f"WITH {DEGREE_SQL}, {TOPIC_SQL}, r AS (SELECT slug, m.id, row_number() OVER (PARTITION BY slug, repo ORDER BY coalesce(degree, 0) DESC, label, m.id) AS rn FROM m LEFT JOIN deg ON m.id = deg.id) SELECT slug, id, rn FROM r WHERE rn <= 12")
def topic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve nodes of a topic for each repository."""
    return _dossier(spark, sf_dir)["nodes"].select("slug", "id", F.col("rn").cast("long").alias("rn"))


@query(
    f"""
WITH {DEGREE_SQL}, {TOPIC_SQL}, b AS (SELECT source AS id, target AS other FROM ({LINKS_SQL}) UNION SELECT target, source FROM ({LINKS_SQL})),
fe AS (SELECT slug, m.id AS what, row_number() OVER (PARTITION BY slug ORDER BY coalesce(degree, 0) DESC, label, m.id) AS rn FROM m LEFT JOIN deg ON m.id = deg.id WHERE m.id LIKE 'p%' AND pos % 4 = 0 OR kind = 'feature' AND NOT (m.id LIKE 's%' AND CAST(substr(m.id, 2) AS BIGINT) % 3 = 1)),
ti AS (SELECT slug, s_name AS what, row_number() OVER (PARTITION BY slug ORDER BY count(DISTINCT m.id) DESC, s_name) AS rn FROM m JOIN b ON m.id = b.id JOIN supplier ON b.other = 's' || s_suppkey WHERE s_suppkey % 3 = 1 GROUP BY slug, s_name),
su AS (SELECT slug, CAST(doc_id AS VARCHAR) AS what, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS rn FROM (SELECT DISTINCT slug, doc_id FROM documents JOIN tp ON contains(lower(text), w))),
de AS (SELECT slug, CAST(p_partkey AS VARCHAR) AS what, row_number() OVER (PARTITION BY slug ORDER BY p_partkey % 2, p_partkey) AS rn FROM (SELECT DISTINCT slug, p_partkey FROM part JOIN tp ON contains(lower(p_name || ' ' || p_type), w)))
SELECT 'feature' AS part, slug, what, rn FROM fe WHERE rn <= 25 UNION ALL SELECT 'ticket', * FROM ti WHERE rn <= 40 UNION ALL SELECT 'summary', * FROM su WHERE rn <= 20 UNION ALL SELECT 'described', * FROM de WHERE rn <= 40"""
)
def topic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's features, tickets one hop away, summaries and described tickets, each up to its number."""
    found = _dossier(spark, sf_dir)
    out = None
    for part, frame, what in (("feature", "features", "id"), ("ticket", "tickets", "ticket"), ("summary", "summaries", "community"), ("described", "described", "ticket")):
        rows = found[frame].select(F.lit(part).alias("part"), "slug", F.col(what).cast("string").alias("what"), F.col("rn").cast("long").alias("rn"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""
WITH ix AS (SELECT 'r' || (path % 3) AS repo, 'f' || path AS path, ticket FROM ({INDEX_SQL})), mi AS (SELECT DISTINCT path, ticket FROM ix WHERE repo = 'r1'), ch AS (SELECT path AS a, '' AS b, count(*) AS n FROM mi GROUP BY path ORDER BY n DESC, path LIMIT 15),
sz AS (SELECT ticket FROM mi GROUP BY ticket HAVING count(*) BETWEEN 2 AND 40), co AS (SELECT x.path AS a, y.path AS b, count(*) AS n FROM mi x JOIN mi y ON x.ticket = y.ticket AND x.path < y.path WHERE x.ticket IN (SELECT ticket FROM sz) GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, a, b LIMIT 25),
fe AS (SELECT 's' || (ticket % 30) AS a, '' AS b, count(DISTINCT ticket) AS n FROM mi GROUP BY 1 ORDER BY n DESC, a LIMIT 15)
SELECT 'churn' AS part, * FROM ch UNION ALL SELECT 'cochange', * FROM co UNION ALL SELECT 'features', * FROM fe"""
)
def dive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's churn, co-change and features, each up to its number."""
    from ..settings import DEFAULTS

    ix = index(spark, sf_dir).select(F.concat(F.lit("r"), F.col("path") % 3).alias("repo"), F.concat(F.lit("f"), "path").alias("path"), "ticket")
    feats = ix.select(F.concat(F.lit("s"), F.col("ticket") % 30).alias("id"), F.lit("label").alias("label"), "ticket").groupBy("id", "label").agg(F.collect_set("ticket").alias("tickets"))
    records = ix.select("ticket").distinct().withColumns({"d": F.array(F.lit("x")), "first": F.lit("2024-01-01")})
    own = nodes(spark, sf_dir)
    found = history.dive_bundle(own, ix, records, feats, graph.degree(links(spark, sf_dir)), "r1", DEFAULTS.with_overrides({"dive_min_cochange": 2}))
    rows = [found["churn"].select(F.lit("churn").alias("part"), F.col("path").alias("a"), F.lit("").alias("b"), F.col("tickets").alias("n")), found["cochange"].select(F.lit("cochange").alias("part"), "a", "b", "n")]
    rows.append(found["features"].select(F.lit("features").alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.size("tickets").cast("long").alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'carried' ELSE 'authored' END AS origin, count(*) AS summaries, count(*) FILTER (WHERE p_partkey % 3 = 0) AS flagged, round(count(*) FILTER (WHERE p_partkey % 3 = 0) / count(*), 6) AS share FROM part GROUP BY 1")
def grounding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with a claim that nothing grounds, by where they come from."""
    prose = made(spark, sf_dir, "part", "p_partkey AS community ;; concat('It calls known_name and ', if(p_partkey % 3 = 0, 'other_name', 'KnownName.java')) AS text")
    own = made(spark, sf_dir, "part", "p_partkey AS community ;; explode(array('known_name', 'KnownName')) AS identifier")
    return dossier.verify(prose, own, prose.where("community % 4 = 0")).withColumn("share", F.round("share", 6))


@query("SELECT p_partkey AS community, 'estate_name' AS identifier FROM part WHERE false UNION ALL SELECT p_partkey, 'other_name' FROM part WHERE p_partkey % 3 = 0")
def estate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that neither their own evidence nor the estate's holds."""
    prose = made(spark, sf_dir, "part", "p_partkey AS community ;; concat('It has estate_name and ', if(p_partkey % 3 = 0, 'other_name', 'own_name')) AS text")
    own = made(spark, sf_dir, "part", "p_partkey AS community ;; 'own_name' AS identifier")
    return dossier.ungrounded(prose, own, estate=spark.createDataFrame([("EstateName",), ("estate_name",)], "identifier string"))


@query(f"WITH c AS (SELECT DISTINCT community FROM ({NODES_SQL}) WHERE repo = 'Brand#3' AND community IS NOT NULL) SELECT count(*) FILTER (WHERE community % 3 = 0) AS covered, count(*) FILTER (WHERE community % 3 <> 0) AS uncovered FROM c")
def summary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's communities with and without a summary."""
    return dossier.summary_coverage(nodes(spark, sf_dir), spark.range(0, 99, 3).select(F.col("id").alias("community")), "Brand#3")


@query(
    """
WITH o AS (SELECT o_custkey AS c, count(*) AS degree FROM orders GROUP BY 1), n AS (SELECT c_nationkey AS community, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(degree, 0) DESC, c_custkey) AS rn FROM customer LEFT JOIN o ON c_custkey = c),
z AS (SELECT community FROM n GROUP BY 1 HAVING count(*) >= 25), r AS (SELECT community, c_mktsegment, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, min(rn)) AS q FROM n GROUP BY 1, 2)
SELECT CAST(z.community AS BIGINT) AS community, CASE WHEN z.community % 4 = 0 THEN 'given ' || z.community ELSE r.c_mktsegment || ': ' || c_name END AS label FROM z JOIN r ON r.community = z.community AND q = 1 JOIN n ON n.community = z.community AND n.rn = 1"""
)
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """communities' labels, as they are given or else from their repository and first node."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("repo"), F.lit(None).cast("string").alias("source_file"), F.col("c_nationkey").cast("long").alias("community"), F.lit(None).cast("string").alias("kind"))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("degree"))
    given = spark.range(25).select(F.col("id").cast("string").alias("community"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("given "), "id")).otherwise("").alias("label"))
    return dossier.community_digest(c, d, given).select("community", "label")


@query(f"SELECT id AS node_id, CAST(community AS VARCHAR) AS community FROM ({NODES_SQL}) WHERE community IS NOT NULL")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is in which community."""
    return graph.membership(nodes(spark, sf_dir))


@query("SELECT c_custkey AS id FROM (SELECT c_custkey, row_number() OVER (ORDER BY length(CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i IN (SELECT CAST(floor(j * (SELECT count(*) FROM customer) / 40.0) AS BIGINT) FROM range(40) t(j))")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty ids at even steps."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return dossier.sample_ids(ids, 40).select(F.col("id").cast("long").alias("id"))


# --- answers ------------------------------------------------------------


@query(f"WITH {BFS_SQL}, en AS (SELECT id, CAST(substr(id, 2) AS BIGINT) * 2 + CASE WHEN id LIKE 's%' THEN 1 ELSE 0 END AS eid, repo FROM ({NODES_SQL})) SELECT repo, count(*) AS n, min(eid) AS first FROM reach JOIN en ON reach.node = en.id GROUP BY repo ORDER BY n DESC, first LIMIT 8")
def reached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repositories with the most of what was reached."""
    own = nodes(spark, sf_dir).select("id", (F.substring("id", 2, 20).cast("long") * 2 + F.col("id").startswith("s").cast("long")).alias("eid"), "repo")
    reached = graph.bfs(graph.both_ways(links(spark, sf_dir)), spark.createDataFrame([("p7",)], "node string"), 2).join(own, F.col("node") == F.col("id")).select("eid", "dist")
    return retrieval.grouped(reached, own, "repo")


@query("SELECT p_partkey AS eid FROM part WHERE p_partkey % 40 = 7 OR p_partkey % 9 = 7")
def ticket_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that carry a ticket."""
    own = made(spark, sf_dir, "part", "p_partkey AS eid ;; array(p_partkey % 40, p_partkey % 9) AS t").select("eid", F.transform("t", lambda x: F.concat(F.lit("T-"), x)).alias("tickets"))
    return retrieval.entries_with_ticket(own, "T-7").select("eid")


@query(f"SELECT eid, label FROM ({ENTRIES_SQL}) WHERE eid % 3 = 0 ORDER BY eid % 11 DESC, eid LIMIT 6")
def feature_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the features with the most links."""
    own = entries(spark, sf_dir).withColumns({"kind": F.when(F.col("eid") % 3 == 0, "feature").otherwise("code"), "degree": F.col("eid") % 11})
    return reports.feature_cards(own, 6).select("eid", "label")


@query(
    f"""
WITH e AS ({ENTRIES_SQL}), s AS (SELECT eid, l, 1000 - eid % 997 AS score FROM e), t AS (SELECT * FROM s ORDER BY score DESC, eid LIMIT 10),
w AS (SELECT 'red' AS w, 0 AS i UNION ALL SELECT 'eco', 1 UNION ALL SELECT 'zzzz', 2), x AS (SELECT w, i, arg_min(eid, (1000 - score) * 10000000 + eid) AS eid FROM w JOIN s ON contains(l, w) WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(t.l, w)) GROUP BY w, i),
y AS (SELECT eid, min(i) AS i FROM x GROUP BY eid)
SELECT eid FROM t UNION SELECT y.eid FROM y WHERE NOT EXISTS (SELECT 1 FROM x JOIN s ON x.eid = s.eid JOIN w ON w.i = y.i WHERE x.i < y.i AND contains(s.l, w.w))"""
)
def answer_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best entries, and the best of each term that they miss."""
    ranked = entries(spark, sf_dir).withColumn("score", (1000 - F.col("eid") % 997).cast("double"))
    return spark.createDataFrame([(e,) for e in retrieval.pick_seeds(ranked, ["red", "eco", "zzzz"])], "eid long")


@query(
    """
WITH n AS (SELECT DISTINCT 't' || (p_partkey % 6) AS token, 'o' || (p_partkey % 10) AS other, CAST(0.5 + (p_partkey % 10) / 20.0 AS DOUBLE) AS score, p_partkey % 10 + 1 AS rank FROM part),
x AS (SELECT other, score, row_number() OVER (PARTITION BY other ORDER BY token, rank) AS rn FROM n WHERE token IN ('t1', 't2') AND rank <= 3)
SELECT other, round(greatest(0.1, score - 0.35), 6) AS weight FROM x WHERE rn = 1"""
)
def expanded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours of each term, first come, at a discount."""
    near = made(spark, sf_dir, "part", "concat('t', p_partkey % 6) AS token ;; concat('o', p_partkey % 10) AS other ;; cast(0.5 + (p_partkey % 10) / 20.0 AS double) AS score ;; p_partkey % 10 + 1 AS rank").distinct()
    return spark.createDataFrame([(o, round(w, 6)) for o, w in retrieval.expand_terms(["t1", "t2"], near)], "other string, weight double")


# --- gates and reports --------------------------------------------------


@query("SELECT false AS parts, true AS none, 2 AS nothing, 1 AS broken, 0 AS sound")
def gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q4: whether no node has a repository, and the answer gate's exit codes."""
    own = nodes(spark, sf_dir)
    modes = table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "graph").otherwise("dive").alias("mode"))
    rows = modes.select(F.array("mode").alias("accept"), F.array(F.lit("graph")).alias("met"))
    codes = (status.gate_code(None, rows), status.gate_code(rows, retrieval.gate(rows)), status.gate_code(rows, retrieval.gate(rows.where("accept[0] = 'graph'"))))
    return spark.createDataFrame([(gates.missing_repo(own), gates.missing_repo(own.withColumn("repo", F.lit(""))), *codes)], "parts boolean, none boolean, nothing int, broken int, sound int")


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'undeterminable' WHEN 1 THEN 'unrecorded' WHEN 2 THEN 'same' ELSE 'different' END AS verdict FROM part")
def partitioner_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a recorded partitioner compares with the one at hand."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN NULL WHEN 2 THEN 'b' ELSE 'c' END AS r ;; CASE p_partkey % 4 WHEN 0 THEN NULL ELSE 'b' END AS h")
    return rows.select("k", gates.partitioner_verdict(F.col("r"), F.col("h")).alias("verdict"))


@query(f"WITH n AS ({NODES_SQL}), x AS (SELECT 'nodes' AS figure, count(*) AS here, count(*) FILTER (WHERE id LIKE 'p%') AS there FROM n UNION ALL SELECT 'communities', count(DISTINCT community), count(DISTINCT community) FILTER (WHERE id LIKE 'p%') FROM n UNION ALL SELECT 'clustered', count(community), count(community) FILTER (WHERE id LIKE 'p%') FROM n) SELECT * FROM x WHERE here <> there")
def counterpart_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: figures in which two graphs disagree."""
    own = nodes(spark, sf_dir)
    return status.partitioner_gap(graph.clustering_counts(own), graph.clustering_counts(own.where("id LIKE 'p%'")))


@query("SELECT * FROM (VALUES ('few', true), ('disjoint', true), ('gone', true), ('sound', false)) v(shape, refused)")
def remap_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: memberships between which a remap makes no sense."""
    own = graph.membership(nodes(spark, sf_dir))
    shapes = {"few": (own, own.limit(3)), "disjoint": (own, own.withColumn("node_id", F.concat(F.lit("x"), "node_id"))), "gone": (own, own.where("node_id LIKE 's%'").unionByName(own.limit(20)).distinct()), "sound": (own, own)}

    def refused(old: DataFrame, new: DataFrame) -> bool:
        try:
            graph.check_remap(old, new)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(*v)) for k, v in shapes.items()], "shape string, refused boolean")


@query(
    """
SELECT 'd' || p_partkey || '/CLAUDE.md' AS path, 'instructions' AS finding FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'd' || p_partkey || '/settings.json', 'executable' FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT 'd' || p_partkey || '/.cursor', 'config-dir' FROM part WHERE p_partkey % 4 = 2"""
)
def corpus_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a corpus that a harness would obey."""
    rows = made(
        spark, sf_dir, "part",
        "explode(CASE p_partkey % 4 WHEN 0 THEN array(concat('d', p_partkey, '/CLAUDE.md'), concat('d', p_partkey, '/.git/CLAUDE.md')) WHEN 1 THEN array(concat('d', p_partkey, '/settings.json')) WHEN 2 THEN array(concat('d', p_partkey, '/.cursor/a.txt'), concat('d', p_partkey, '/.cursor/b.txt')) ELSE array(concat('d', p_partkey, '/a.json')) END) AS path ;; '{\"hooks\": {}}' AS content",
    )
    return gates.corpus_config(rows)


@query("SELECT 'a' AS \"check\", 'finding' AS state, count(*) AS findings FROM part WHERE p_size > 5 UNION ALL SELECT 'b', 'ok', 0 UNION ALL SELECT 'c', 'unknown', -1")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks with findings, without, and those that couldn't be made."""
    p = table(spark, sf_dir, "part")
    return status.report(spark, {"a": p.where("p_size > 5"), "b": p.where("p_size < 0"), "c": None}).fillna(-1, ["findings"])


@query(f"WITH x AS (SELECT DISTINCT repo FROM ({NODES_SQL}) WHERE id LIKE 'p%') SELECT (SELECT count(*) FROM x) AS mined, (SELECT count(*) FROM x) + 25 AS estate")
def intent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that the index has files of."""
    p = nodes(spark, sf_dir).where("id LIKE 'p%'")
    more = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return status.intent_coverage(p, p.select(F.col("repo").alias("name")).unionByName(more))


@query(f"SELECT DISTINCT source_file AS path FROM ({NODES_SQL}) WHERE source_file LIKE 'features/%'")
def dangling_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited files that aren't there."""
    own = nodes(spark, sf_dir)
    return status.dangling_citations(own, own.where("id LIKE 'p%'").select(F.col("source_file").alias("path")))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN '(no repository)' ELSE 'r' END AS repo, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def contentless_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that carry nothing but their identity."""
    rows = made(spark, sf_dir, "part", "cast(p_partkey AS string) AS id ;; if(p_partkey % 3 = 0, '', 'r') AS repo ;; p_partkey AS pos ;; if(p_partkey % 2 = 0, '', p_name) AS label ;; if(p_partkey % 2 = 0, array(), array('x')) AS tickets")
    return graph.contentless(rows)


@query("SELECT line, value FROM (VALUES (1, 'NATION_1'), (3, 'none'), (4, 'NATION_??x'), (5, 'gone')) v(line, value) WHERE line > 1")
def unmatched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Including rules that no repository matches."""
    rules = [(0, "match", "NATION_?"), (1, "prefix", "NATION_1"), (2, "repo", "NATION_3"), (3, "prefix", "none"), (4, "match", "NATION_??x"), (5, "fetch", "gone"), (6, "exclude", "nobody")]
    return gates.unmatched_rules(spark.createDataFrame(rules, "line int, kind string, value string"), table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).select("line", "value")


@query("SELECT 'r' || (p_partkey % 3) AS repo, CASE p_partkey % 4 WHEN 0 THEN 'broken' WHEN 1 THEN 'duplicating' ELSE 'misattributing' END AS outcome, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY ALL")
def symlink_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what symbolic links would do to a corpus."""
    rows = made(spark, sf_dir, "part", "concat('r', p_partkey % 3) AS repo ;; if(p_partkey % 5 = 0, '.git/a.py', concat('a', p_partkey, '.PY')) AS path ;; CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x/b.py' WHEN 2 THEN 'x/b.txt' ELSE '/etc/b.py' END AS target ;; p_partkey % 4 <> 3 AS inside")
    return discovery.symlink_outcomes(rows, (".py",))


@query("SELECT 'n' || p_partkey || '_c' || lpad(CAST(p_partkey % 20 + 10 AS VARCHAR), 2, '0') AS final_id FROM part WHERE p_partkey % 3 = 0")
def suffix_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids that a chunk has left its suffix on."""
    rows = made(spark, sf_dir, "part", "concat('n', p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('_c', lpad(p_partkey % 20 + 10, 2, '0')) WHEN 1 THEN '_c1' ELSE '_calc22' END) AS final_id")
    return resolve.suffix_breaches(rows)


@query("SELECT 'd/f' || p_partkey || '.docx' AS path FROM part WHERE p_partkey % 4 = 0")
def convertible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office documents to convert."""
    return gates.convertible(made(spark, sf_dir, "part", "CASE p_partkey % 4 WHEN 0 THEN concat('d/f', p_partkey, '.docx') WHEN 1 THEN concat('tests/f', p_partkey, '.XLSX') WHEN 2 THEN concat('d/f', p_partkey, '.md') ELSE concat('x/unit-tests/f', p_partkey, '.csv') END AS path"))


@query("SELECT p_partkey AS k, u.c AS command FROM part, LATERAL (SELECT unnest(['pip install p' || p_partkey || ' -q', 'make all']) AS c) u")
def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of fenced shell blocks."""
    content = "concat('# A\\n```bash\\n$ pip install p', p_partkey, ' \\\\\\n   -q  # quietly\\n\\n# alone\\nmake all\\n```\\n```python\\nno()\\n```\\n')"
    return gates.shell_commands(made(spark, sf_dir, "part", f"p_partkey AS k ;; {content} AS content"))


@query("SELECT 'f' || p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT 4 * p_partkey FROM part)")
def uncached_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected paths that no cache has."""
    return discovery.uncached(made(spark, sf_dir, "part", "concat('f', p_partkey) AS path"), made(spark, sf_dir, "part", "concat('f', 4 * p_partkey) AS path"))


@query(
    """
WITH f AS (SELECT 'd' || (p_partkey % 9) || '/f' || p_partkey AS path, CASE p_partkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'image' ELSE 'document' END AS kind, p_partkey AS k FROM part), w AS (SELECT * FROM f WHERE kind <> 'code' AND k % 7 <> 0),
g AS (SELECT *, CASE WHEN kind = 'image' THEN '0' || path ELSE '1' || split_part(path, '/', 1) END AS grp FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY path) - 1 AS rn FROM g),
s AS (SELECT grp, sum(c) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM (SELECT grp, (count(*) + 4) // 5 AS c FROM g GROUP BY grp))
SELECT lpad(CAST(coalesce(start, 0) + rn // 5 + 1 AS VARCHAR), 4, '0') AS chunk, rn % 5 AS pos, path FROM n JOIN s USING (grp)"""
)
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan without code, of uncached files alone, images by themselves."""
    files = made(spark, sf_dir, "part", "concat('d', p_partkey % 9, '/f', p_partkey) AS path ;; CASE p_partkey % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'image' ELSE 'document' END AS kind ;; p_partkey")
    return gates.chunk_plan(files.select("path", "kind"), 5, gates.requested_kinds("document, image"), files.where("p_partkey % 7 <> 0").select("path"))


@query("SELECT sha256(string_agg(token, chr(10) ORDER BY df DESC, token)) AS digest FROM (SELECT p_name AS token, count(*) AS df FROM part GROUP BY 1)")
def vocabulary_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a vocabulary in its order."""
    vocab = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("token")).agg(F.count("*").alias("df"))
    return spark.createDataFrame([(semantic.vocabulary_hash(vocab),)], "digest string")


# --- sources and sinks, by round trip -----------------------------------

PART = struct(p_partkey=L, p_name=S, p_brand=S)


def written(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file of that name and content in the shared folder, written by the store's own file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    return path.toString()


@query("SELECT p_partkey, p_name, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzipped document's array, cut out of its text as it is read."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").toJSON().collect()  # a small document is what is written here
    text = '{"meta": {"parts": ["x"]}, "note": "\\"parts\\": [{", "parts": [' + ", ".join(rows) + '], "links": []}'
    path = written(spark, "doc.json.gz", sinks.gzip_bytes(text))
    return readers.read_array(spark, path, "parts", PART).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT id, label, repo, community, row_number() OVER (ORDER BY pos) - 1 AS at FROM ({NODES_SQL})")
def graph_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as a document and loaded."""
    own = nodes(spark, sf_dir).orderBy("pos").select("id", "label", "repo", "community")
    text = '{"nodes": [' + ", ".join(own.toJSON().collect()) + '], "links": []}'  # a small document is what is written here
    got, _ = readers.read_graph(spark, written(spark, "graph.json", text.encode()))
    return got.select("id", "label", "repo", "community", F.col("pos").cast("long").alias("at"))


@query("SELECT 'chunk_' || (p_partkey % 4) || '.json' AS chunk, count(*) AS nodes, CAST(sum(p_size) AS BIGINT) AS tokens FROM part GROUP BY 1 UNION ALL SELECT 'chunk_bad.json', -1, -1 UNION ALL SELECT 'chunk_none.json', -1, -1")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a folder with their nodes and tokens, and the files that can't be read."""
    parts = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 4).alias("c")).agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"))).alias("nodes"), F.sum("p_size").alias("input_tokens"))
    folder = None
    for r in parts.toJSON().collect():  # four small files
        doc = json.loads(r)
        data = json.dumps({k: doc[k] for k in ("nodes", "input_tokens")}).encode()
        folder = folder or written(spark, "x.json", b"{}").rsplit("/", 1)[0]
        _write(spark, f"{folder}/chunk_{doc['c']}.json", data)
    for name, data in (("chunk_bad.json", b'{"nodes": [{"id"'), ("chunk_none.json", b'{"edges": []}'), ("chunk_x_plan.json", b'{"nodes": []}')):
        _write(spark, f"{folder}/{name}", data)
    chunks, unreadable = readers.read_chunks(spark, folder)
    good = chunks.select("chunk", F.size("nodes").cast("long").alias("nodes"), F.col("input_tokens").alias("tokens"))
    total = resolve.token_totals(chunks).first()["input_tokens"]
    if total != good.agg(F.sum("tokens")).first()[0]:
        raise ValueError("totals differ")
    return good.unionByName(unreadable.select("chunk", F.lit(-1).cast("long").alias("nodes"), F.lit(-1).cast("long").alias("tokens")))


def _write(spark: SparkSession, name: str, data: bytes) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()


@query("SELECT * FROM (VALUES (1, 'pay', 'Payments', 'pay,card'), (3, 'log', 'Logging', 'log')) v(pos, slug, title, keywords)")
def topic_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of topics."""
    path = written(spark, "topics.txt", b"# slug | title | words\npay | Payments | Pay, CARD ,\n\nlog|Logging|log\n")
    return readers.read_topics(spark, path).select("pos", "slug", "title", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT * FROM (VALUES (1, 'prefix', 'app-'), (2, 'exclude', 'app-old'), (4, 'fetch', 'lib x')) v(line, kind, value)")
def filter_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that select repositories."""
    return readers.read_filters(spark, written(spark, "rules.txt", b"# rules\nprefix app-\nexclude   app-old\n\nfetch lib x\n"))


@query("SELECT o_orderpriority AS repository, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY 1")
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, T4: commits as NDJSON by repository, and read again."""
    rows = made(spark, sf_dir, "orders", "o_orderpriority AS repository ;; cast(o_orderkey AS string) AS sha ;; 'x' AS subject")
    path = f"{new_folder(spark)}/commits"
    sinks.write_ndjson(rows, path)
    got = readers.read_commits(spark, f"{path}/*")
    return got.groupBy("repository").agg(F.count("*").alias("n"), F.max(F.col("sha").cast("long")).alias("newest"))


@query("SELECT name, CASE WHEN name = 'NATION_3' THEN 1 ELSE 0 END AS archived, name || '|git@github.com:o/' || name || '.git|main' AS line FROM (SELECT n_name AS name FROM nation) WHERE name <> 'NATION_4'")
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code host's listing, by an injected runner, as lines of the repository list."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    asked: list[list[str]] = []

    def runner(args: list[str]) -> str:
        asked.append(args)
        return "\n".join(json.dumps({"name": n, "defaultBranch": "main"}) for n in names) + "\n\n"

    found = discovery.discover(spark, [("prefix", "NATION_"), ("exclude", "NATION_4")], "o", runner)
    if len(asked) != 1 or "--paginate" not in asked[0]:
        raise ValueError("one paginated call expected")
    return discovery.config_lines(found, "o").select("name", (F.col("name") == "NATION_3").cast("int").alias("archived"), "line")


@query("SELECT 'estate' AS scope, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'old' ELSE 'sha-' || n_name END AS sha, n_nationkey % 5 = 0 AS sync_failed FROM nation WHERE n_nationkey % 10 <> 5")
def synced_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories brought up to date by an injected runner; one that fails keeps its old record, if it has one."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()
    failing = {r["n_name"] for r in rows if r["n_nationkey"] % 5 == 0}
    known = made(spark, sf_dir, "nation", "'estate' AS scope ;; n_name AS name ;; 'old' AS sha ;; 'main' AS branch ;; '2024' AS committed ;; n_nationkey").where("n_nationkey % 10 <> 5").drop("n_nationkey")

    def runner(args: list[str]) -> str:
        name = (args[1] if args[0] == "-C" else args[-1]).rsplit("/", 1)[-1]
        if name in failing and "fetch" in args:
            raise RuntimeError("no remote")
        return f"sha-{name}\n" if "rev-parse" in args else "2025-01-01T00:00:00Z\n"

    out, failures = sync.sync(spark, [("estate", r["n_name"], "u", "main") for r in rows], "/clones", known, runner, lambda path: False)
    if len(failures) != len(failing):
        raise ValueError("a failure per failing repository expected")
    return out.select("scope", "name", "sha", "sync_failed")


@query("SELECT o_orderkey AS repository, 1 AS n, 1 AS pages, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) AS year FROM orders")
def exported_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories written as NDJSON and Markdown by year, and read again."""
    folder = new_folder(spark)
    logs = made(spark, sf_dir, "orders", f"concat('r', o_orderkey) AS repository ;; '' AS repository_url ;; {LOG_SQL} AS log").withColumn("repository", F.concat(F.lit("h"), F.substring("repository", 2, 30).cast("long") % 7))
    counts = sync.export_history(logs, folder)
    commits = readers.read_commits(spark, f"{folder}/commits/*")
    pages = spark.read.text(f"{folder}/history", wholetext=False).where("value LIKE '## %'").select(F.regexp_extract("value", "^## ([0-9]+)", 1).alias("short"), "year")
    if counts.agg(F.sum("n")).first()[0] != commits.count() or pages.count() != commits.count():
        raise ValueError("as many commits and sections as records expected")
    own = commits.select(F.col("sha").cast("long").alias("repository"), F.substring("author_date", 1, 4).cast("int").alias("year"))
    return own.groupBy("repository", "year").agg(F.count("*").cast("int").alias("n")).withColumn("pages", F.col("n")).select("repository", "n", "pages", "year")


@query("SELECT p_partkey AS k, 'Totals of ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '' END || chr(10) || '<!-- note -->' || chr(10) || 'now ' || p_size AS report FROM part")
def replaced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note behind a marker, replaced where there is one."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; if(p_partkey % 2 = 0, concat('Totals of ', p_name, '.\\n\\n\\n<!-- note -->\\nbefore ', p_size, '\\n'), concat('Totals of ', p_name, '\\n')) AS report ;; concat('now ', p_size) AS note")
    once = rows.withColumn("report", sync.with_note(F.col("report"), "<!-- note -->", F.col("note")))
    return once.select("k", sync.with_note(F.col("report"), "<!-- note -->", F.col("note")).alias("report"))


@query("SELECT p_partkey AS k, p_partkey % 3 <> 2 AS declared, CASE p_partkey % 3 WHEN 0 THEN 'https://i.example/' || p_partkey END AS url FROM part")
def package_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package indexes that lists of requirements name."""
    rows = made(spark, sf_dir, "part", "p_partkey AS k ;; CASE p_partkey % 3 WHEN 0 THEN concat('a==1\\n  --index-url https://i.example/', p_partkey, ' \\nb') WHEN 1 THEN '--index-url\\na' ELSE '# --index-url x\\na --index-url y' END AS c")
    return rows.select("k", sync.declares_index(F.col("c")).alias("declared"), sync.index_url(F.col("c")).alias("url"))


@query("SELECT 'P' || (o_custkey % 9) AS prefix, count(*) AS n FROM orders WHERE o_custkey % 9 > 3 GROUP BY 1")
def undecided_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes that nobody has decided about; addresses with credentials are refused without being repeated."""
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), F.col("o_custkey") % 9, F.lit("-"), "o_orderkey").alias("ticket"))
    for bad in ("https://user:secret@t.example", "ftp://t.example", "t.example"):
        try:
            tracker.api_root(bad)
        except ValueError as e:
            if "secret" in str(e):
                raise
        else:
            raise ValueError("address accepted")
    return tracker.undecided(keys, DEFAULTS.with_overrides({"tracker_projects": ("P0", "P1"), "tracker_deny": ("P2", "P3")}))


@query("SELECT n_nationkey, n_name FROM nation")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page that holds rows as JSON, and those rows read out of it."""
    html = reports.page("t", {"nations": table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name")), "none": spark.range(0)})
    blocks = readers.json_blocks(spark.createDataFrame([(html,)], "html string")).where("block_id = 'nations'")
    return blocks.select(F.explode(F.from_json("json", "array<struct<n_nationkey:int,n_name:string>>")).alias("r")).select("r.*")


@query(
    """
SELECT '| `r' || k || '` | ' || n || ' | ' || CASE WHEN k < 3 THEN '2024-05-06 (`abcdef01`)' ELSE '—' END || ' | `u' || k || '` |' AS line
FROM (SELECT o_custkey % 5 AS k, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'These ' || count(DISTINCT o_custkey % 5) || ' repositories were read, and no others: what is missing here was never looked at.' FROM orders"""
)
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the manifest's rows, and how many repositories it speaks of."""
    commits = made(spark, sf_dir, "orders", "concat('r', o_custkey % 5) AS repository ;; concat('u', o_custkey % 5) AS repository_url ;; o_orderkey AS pos")
    known = spark.createDataFrame([(f"r{i}", "abcdef0123", "2024-05-06T07:08:09Z") for i in range(3)], "name string, sha string, committed string")
    lines = [x for x in reports.manifest(commits, known) if x.startswith(("| `", "These"))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT * FROM (VALUES ('What is AB-7?', 'ticket', 'ticket'), ('zzzzqq qqzz', 'abstain', 'abstain'), ('which repositories have red', 'which_repos', 'tickets,graph'), ('why red', 'why', 'tickets,graph'), ('walk me through red', 'cluster', 'tickets,graph'), ('red and zzzzqq', 'cluster', 'tickets,graph')) v(question, view, modes)")
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered: by a ticket, by saying that nothing is known, or by the view they ask for; a journey without features is a cluster."""
    own = entries(spark, sf_dir).withColumns({"tickets": F.array(F.concat(F.lit("AB-"), "eid")), "degree": F.col("eid") % 9})
    links_ = own.select(F.col("eid").alias("node"), (F.col("eid") + 1).alias("other"))
    edges = links_.unionByName(links_.toDF("other", "node"))
    tickets = table(spark, sf_dir, "part").select(F.concat(F.lit("AB-"), "p_partkey").alias("id"), F.lower("p_name").alias("hay"))
    out = []
    for q in ("What is AB-7?", "zzzzqq qqzz", "which repositories have red", "why red", "walk me through red", "red and zzzzqq"):
        answer = retrieval.ask(q, own, edges, tickets)
        out.append((q, answer.view, ",".join(retrieval.mode_of(answer))))
    return spark.createDataFrame(out, "question string, view string, modes string")

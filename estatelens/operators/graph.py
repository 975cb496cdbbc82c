"""Property-graph operators over ``nodes`` (id, label, repo, source_file, community, file_type, kind, pos, ...) and ``links`` (source, target, ...).

Links are undirected when read. ``pos`` is a node's place in its file and breaks ties. Every ranking has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_minified, text
from ..settings import DEFAULTS, Settings
from .shared import durable

# Legacy names of node kinds, and kinds that are always entries.
KIND_ALIASES = {"gherkin_feature": "feature", "gherkin_scenario": "scenario", "jira_ticket": "ticket"}
BUSINESS_KINDS = ("feature", "scenario", "ticket")
DEPLOYMENT_KINDS = ("deployment", "environment")


def kind_of(kind: Column) -> Column:
    """A kind by its present name; absent is empty."""
    aliases = F.create_map(*[F.lit(x) for pair in KIND_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, kind), kind, F.lit(""))


def entry_kind(kind: Column, file_type: Column) -> Column:
    k = kind_of(kind)
    return F.when(k.isin(*BUSINESS_KINDS, *DEPLOYMENT_KINDS), k).when(text(file_type) == "code", "code").otherwise("concept")


def endpoints(links: DataFrame) -> DataFrame:
    """One row for each end of each link."""
    return links.select(F.explode(F.array("source", "target")).alias("id"))


def degree(links: DataFrame) -> DataFrame:
    """Link ends by node: parallel links count each, a self-loop twice."""
    return endpoints(links).groupBy("id").agg(F.count("*").alias("degree"))


def both_ways(links: DataFrame) -> DataFrame:
    """(node, other) pairs in both directions, one for each link: enough for a traversal, which drops duplicates as it goes."""
    both = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"))))
    return links.select(both.alias("e")).select("e.*")


def symmetric(links: DataFrame) -> DataFrame:
    """Distinct (node, other) pairs in both directions."""
    return both_ways(links).distinct()


def include_entry(node_degree: Column, settings: Settings = DEFAULTS) -> Column:
    """Whether a node is an entry: deployments, business kinds and packages are; minified, hidden and test symbols are not; code needs its degree."""
    kind, label, path = kind_of(F.col("kind")), text("label"), text("source_file")
    test = path.contains(".spec.") | path.contains("__tests__") | path.contains("/test/")
    test = test & ~text("repo").isin(*settings.e2e_repos) if settings.e2e_repos else test
    return (
        F.when(label == "", False)
        .when(kind.isin(*DEPLOYMENT_KINDS), True)
        .when(is_minified(label), False)
        .when(kind.isin(*BUSINESS_KINDS), True)
        .when(text("type") == "package", True)
        .when(label.startswith("."), False)
        .when(test, False)
        .otherwise(node_degree >= settings.min_entry_degree)
    )


def entries(nodes: DataFrame, links: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The nodes that are entries, with their degree and kind, in rank order: degree descending, then file order."""
    joined = nodes.join(degree(links), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.where(include_entry(F.col("degree"), settings)).withColumn("entry_kind", entry_kind(F.col("kind"), F.col("file_type")))


def with_rank(df: DataFrame, *order: Column, name: str = "eid", weight: str | None = None) -> DataFrame:
    """Consecutive numbers from 0 in a total order (or the sum of ``weight`` over all rows before), without a single-task window.

    Range partitions are written to the shared folder, counted, and numbered within; what is numbered is what was counted,
    whatever executors are lost in between.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    size = F.count("*") if weight is None else F.sum(weight).cast("long")
    sizes = placed.groupBy("_p").agg(size.alias("n"), F.min("_i").alias("_first")).orderBy("_p").collect()  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_p"], r["_first"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0, 0)], "_p int, _first long, _start long")
    before = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_i") - F.col("_first") if weight is None else F.coalesce(F.sum(weight).over(before), F.lit(0))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, own + F.col("_start")).drop("_p", "_i", "_first", "_start")


def kept_edges(links: DataFrame, kept: DataFrame, rank: str = "eid") -> DataFrame:
    """Distinct pairs (s, t), s < t, of the ranks of entries that a link joins; self-loops drop."""
    own = kept.select("id", rank)
    a, b = own.toDF("source", "_a"), own.toDF("target", "_b")
    pairs = links.select("source", "target").join(a, "source").join(b, "target")
    return pairs.where("_a <> _b").select(F.least("_a", "_b").alias("s"), F.greatest("_a", "_b").alias("t")).distinct()


def top_neighbours(nodes: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    """Each node's ``k`` neighbours of different labels: degree descending, id ascending, a label's first only.

    All ends of links are numbered in that order once, so that pairs, the first of a label and the rank are of longs,
    aggregated by hash. An end that is no node has neighbours, and is none itself.
    """
    known = with_rank(degree(links).join(nodes.select("id", "label"), "id", "left"), F.desc("degree"), F.asc("id"), name="at")
    numbers = known.select("id", "at")
    ends = links.select("source", "target").join(numbers.toDF("source", "a"), "source").join(numbers.toDF("target", "b"), "target")
    one = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = known.where("label <> ''").select(F.col("at").alias("other"), F.col("label").alias("other_label"))
    # one row a label with map-side combine, then the rank over what is left
    first = one.select(both.alias("e")).select("e.*").join(labels, "other").groupBy("node", "other_label").agg(F.min("other").alias("other"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("rank") <= k)
    named = ranked.join(numbers.toDF("_node", "node"), "node").join(known.select(F.col("at").alias("other"), "degree", F.col("id").alias("_other")), "other")
    return named.select(F.col("_node").alias("node"), "other_label", "degree", F.col("_other").alias("other"), "rank")


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """Nodes within ``hops`` of the seeds (column node) with their distance. The cap is looked at after a whole level, so the last level may pass it.

    ``edges`` is symmetric (node, other). Levels are few and bounded, and each is a join and an anti-join. What a level has
    reached is written to the shared folder, so that the next one doesn't work it out again.
    """
    seen = seeds.select("node").distinct().withColumn("dist", F.lit(0))
    front = seen
    for d in range(1, hops + 1):
        if cap is not None and d > 1 and seen.limit(cap + 1).count() > cap:
            break
        new = edges.join(front.select("node"), "node").select(F.col("other").alias("node")).distinct()
        front = new.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d))
        front = durable(front) if d < hops else front
        seen = seen.unionByName(front)
    return seen


def impact(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of a reached set, by repository, its nodes and communities."""
    return reached.join(nodes, reached["node"] == nodes["id"]).groupBy("repo").agg(F.count("*").alias("reached"), F.count_distinct("community").alias("communities"))


def same_label(nodes: DataFrame, label: str | None = None) -> DataFrame:
    """Labels found in more than one repository, with their repositories, and with the flag that a link joins two of the nodes left to ``connected``."""
    named = nodes.withColumn("label_lower", F.lower("label")).where("label_lower <> '' AND coalesce(repo, '') <> ''")
    named = named if label is None else named.where(F.col("label_lower") == label.lower())
    return named.groupBy("label_lower").agg(F.count("*").alias("n_nodes"), F.count_distinct("repo").alias("n_repos"), F.array_sort(F.collect_set("repo")).alias("repos")).withColumn("independent", F.col("n_repos") > 1)


def connected_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of which two nodes of different repositories are linked."""
    own = nodes.select("id", "repo", F.lower("label").alias("label_lower"))
    a, b = own.toDF("source", "repo_a", "label_lower"), own.toDF("target", "repo_b", "label_b")
    return links.select("source", "target").join(a, "source").join(b, "target").where("label_lower = label_b AND repo_a <> repo_b").select("label_lower").distinct()


def membership(nodes: DataFrame) -> DataFrame:
    """(node_id, community) of the clustered nodes, communities as text."""
    return nodes.where("community IS NOT NULL").select(F.col("id").alias("node_id"), F.col("community").cast("string").alias("community"))


def overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of each pair of an old and a new community (node_id, community): shared members, recall and precision. Old sizes count members that are gone."""
    olds, news = old.toDF("node_id", "old"), new.toDF("node_id", "new")
    shared = olds.join(news, "node_id").groupBy("old", "new").agg(F.count("*").alias("shared"), F.min("node_id").alias("first"))
    old_size, new_size = olds.groupBy("old").agg(F.count("*").alias("old_size")), news.groupBy("new").agg(F.count("*").alias("new_size"))
    out = shared.join(old_size, "old").join(new_size, "new")
    return out.withColumns({"recall": F.col("shared") / F.col("old_size"), "precision": F.col("shared") / F.col("new_size")})


def check_remap(old: DataFrame, new: DataFrame, floor: int = 10, coverage: float = 0.5) -> dict[str, int]:
    """Raises where a remap makes no sense: too few members on a side, disjoint ids, or too little of the old membership left."""
    a, b = old.agg(F.count("*").alias("n")).first()["n"], new.agg(F.count("*").alias("n")).first()["n"]
    both = old.select("node_id").join(new.select("node_id"), "node_id", "left_semi").count()
    if a < floor or b < floor:
        raise ValueError(f"too few clustered nodes: {a} before, {b} now")
    if not both:
        raise ValueError("no node id is in both memberships")
    if both < coverage * a:
        raise ValueError(f"only {both} of {a} nodes are left")
    return {"old": a, "new": b, "both": both}


def remap(old: DataFrame, new: DataFrame, bar: float = 0.6, least_precision: float = 0.2) -> DataFrame:
    """For each old community the new one it lands in most, and its outcome: carried, below-bar, imprecise or collision.

    A contested target goes to the highest share of the old community, then to the shorter and the lesser id.
    """
    best = overlaps(old, new).withColumn("rn", F.row_number().over(Window.partitionBy("old").orderBy(F.desc("shared"), "first", "new"))).where("rn = 1").drop("rn", "first")
    claims = best.withColumn("ok", (F.col("recall") >= bar) & (F.col("precision") >= least_precision))
    order = Window.partitionBy("new", "ok").orderBy(F.desc("recall"), F.length("old"), "old")
    claims = claims.withColumn("place", F.when(F.col("ok"), F.row_number().over(order)))
    outcome = F.when(F.col("recall") < bar, "below-bar").when(F.col("precision") < least_precision, "imprecise").when(F.col("place") > 1, "collision").otherwise("carried")
    return claims.select("old", "new", "shared", F.bround("recall", 3).alias("recall"), F.bround("precision", 3).alias("precision"), outcome.alias("outcome"))


def precision_bands(claims: DataFrame) -> DataFrame:
    band = F.when(F.col("precision") >= 0.8, "0.8").when(F.col("precision") >= 0.5, "0.5").when(F.col("precision") >= 0.2, "0.2").otherwise("0.0")
    return claims.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def replace_layer(nodes: DataFrame, links: DataFrame, origin: str, new_nodes: DataFrame, new_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with one origin's nodes, and all links that touch them, replaced; doing it again changes nothing."""
    gone = nodes.where(text("_origin") == origin).select("id")
    rest = nodes.where(text("_origin") != origin)
    left = links.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return rest.unionByName(new_nodes, allowMissingColumns=True), left.select(*links.columns).unionByName(new_links, allowMissingColumns=True)


IDENTITY = ("id", "local_id", "repo", "_origin", "community", "community_name")


def contentless(nodes: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """By repository, nodes that carry identity and nothing else. ``pos`` is the reader's own and doesn't count."""

    def empty(c: str) -> Column:
        kind = dict(nodes.dtypes)[c]
        none = F.col(c).isNull()
        if kind.startswith(("array", "map")):
            return none | (F.size(c) == 0)
        if kind.startswith("struct"):
            return none | (F.to_json(c) == "{}")
        return none | (F.col(c).cast("string") == "")

    bare, some = F.lit(True), F.lit(False)
    for c in nodes.columns:
        if c in identity:
            some = some | ~empty(c)
        elif c != "pos":
            bare = bare & empty(c)
    name = F.when(text("repo") == "", "(no repository)").otherwise(F.col("repo"))
    return nodes.where(bare & some).groupBy(name.alias("repo")).agg(F.count("*").alias("n"))


def representatives(nodes: DataFrame, *by: str) -> DataFrame:
    """The least id by repository and file, or by repository."""
    return nodes.groupBy(*by).agg(F.min("id").alias("id"))


def clustering_counts(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.count_distinct(F.col("community").cast("string")).alias("communities"), F.count("community").alias("clustered"))

"""Community digests, topic dossiers, prose gates and grounding of prose in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches, text
from ..settings import DEFAULTS, Settings
from .retrieval import bounded

# Shapes of identifiers in prose, words that join prose compounds, and words of speculation.
CAMEL = r"(?U)\b[A-Za-z][a-z0-9]*[a-z0-9][A-Z][A-Za-z0-9]*\b"
SNAKE = r"(?U)\b[A-Za-z]\w*_\w+\b"
DASHED = r"(?U)\b[a-z][a-z0-9]*(?:-[a-z0-9]+){2,}\b"
FILE = r"(?U)\b[\w.-]+\.(?:java|ts|js|py|json|yaml|yml|xml|raml|csv|feature|sql|html|tsx)\b"
TICKET = r"(?U)\b[A-Z]{2,}-\d+\b"
JOINERS = ("to", "in", "of", "and", "or", "for", "with", "the", "a", "an", "at", "on", "by", "from", "as", "per", "vs")
SPECULATION = r"(?iU)\b(probably|likely|presumably|possibly|perhaps|appears to|seems to|suggests that|may be|might be|could be)\b"


def top_per_group(df: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def as_list(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """A group's values in order of rn."""
    return df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", value.alias("v")))), lambda s: s["v"]).alias(name))


def community_digest(nodes: DataFrame, degrees: DataFrame, labels: DataFrame | None = None, file_tickets: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Of each community large enough: size, label, four repositories, twelve nodes, five features, eight tickets.

    Nodes go by degree, then place. Tickets come from the first thirty nodes: one for each of a node's own, and its file's
    first three at their counts (``file_tickets``: repo, source_file, ticket, n, rank).
    """
    sized = nodes.where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= settings.min_community_size)
    own = nodes.join(sized.select("community"), "community").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "pos")))
    repos = top_per_group(own.where(text("repo") != "").groupBy("community", "repo").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("degree")).alias("d"), "pos")).alias("first")), "community", 4, F.desc("n"), "first")
    label_of = F.when(text("source_file") != "", F.concat("label", F.lit(" ("), "source_file", F.lit(")"))).otherwise(F.col("label"))
    top = as_list(ranked.where("rn <= 12"), "community", label_of, "top_nodes")
    features = top_per_group(ranked.where("kind IN ('feature', 'gherkin_feature')").drop("rn"), "community", 5, F.desc("degree"), "pos")
    out = sized.join(as_list(repos, "community", F.col("repo"), "repositories"), "community", "left").join(top, "community", "left").join(as_list(features, "community", F.col("label"), "business_features"), "community", "left")
    if file_tickets is not None:
        first = ranked.where("rn <= 30")
        mine = first.select("community", F.explode("tickets").alias("ticket"), F.lit(1).cast("long").alias("n"), "rn") if "tickets" in nodes.columns else None
        mined = first.join(file_tickets.where("rank <= 3").select("repo", "source_file", "ticket", "n"), ["repo", "source_file"]).select("community", "ticket", "n", "rn")
        votes = (mined if mine is None else mine.unionByName(mined)).groupBy("community", "ticket").agg(F.sum("n").alias("n"), F.min("rn").alias("first"))
        out = out.join(as_list(top_per_group(votes, "community", 8, F.desc("n"), "first", "ticket"), "community", F.col("ticket"), "tickets"), "community", "left")
    if labels is not None:
        given = labels.select(F.col("community").cast(nodes.schema["community"].dataType), F.nullif("label", F.lit("")).alias("_given"))
        out = out.join(given, "community", "left").join(derived_labels(ranked, repos), "community", "left").withColumn("label", F.coalesce("_given", "_derived", F.lit(""))).drop("_given", "_derived")
    return out


def derived_labels(ranked: DataFrame, repos: DataFrame) -> DataFrame:
    """(community, _derived): a name from evidence where none is given: the commonest repository and the first node with a label, or what there is of both."""
    top = ranked.where(text("label") != "").groupBy("community").agg(F.min_by("label", "rn").alias("_top"))
    main = repos.where("rn = 1").select("community", F.col("repo").alias("_repo"))
    return top.join(main, "community", "full_outer").select("community", F.concat_ws(": ", "_repo", "_top").alias("_derived"))


def summary_coverage(nodes: DataFrame, summaries: DataFrame, repo: str) -> DataFrame:
    """(covered, uncovered): of a repository's communities those with and without a summary."""
    own = nodes.where((F.col("repo") == repo) & F.col("community").isNotNull()).select(F.col("community").cast("string").alias("community")).distinct()
    known = summaries.select(F.col("community").cast("string").alias("community")).distinct().withColumn("_has", F.lit(1))
    return own.join(known, "community", "left").agg(F.count("_has").alias("covered"), F.count_if(F.col("_has").isNull()).alias("uncovered"))


def merge_accounts(known: DataFrame, merged: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is known and wasn't merged, and what was merged and isn't known."""
    a, b = known.select(key).distinct(), merged.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def prose_identifiers(c: Column) -> Column:
    """Words of prose that are shaped like claims about code."""
    found = F.array_union(F.array_union(matches(c, FILE, 0), matches(c, TICKET, 0)), F.array_union(matches(c, CAMEL, 0), matches(c, SNAKE, 0)))
    dashed = F.filter(matches(c, DASHED, 0), lambda t: ~F.arrays_overlap(F.split(t, "-"), F.array(*map(F.lit, JOINERS))))
    return F.array_distinct(F.array_union(found, dashed))


def normalised(c: Column) -> Column:
    """Letters and digits alone: what makes two spellings one thing."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spellings(c: Column) -> Column:
    """An identifier and its other spellings: as a Java file, without its last suffix, its dotted parts, with and without Test."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    parts = F.filter(F.split(c, r"\."), lambda p: F.length(p) > 2)
    test = F.when(c.endswith("Test") & (F.length(c) > 4), F.regexp_replace(c, "Test$", "")).otherwise(F.concat(c, F.lit("Test")))
    return F.array_distinct(F.concat(F.array(c, F.concat(c, F.lit(".java")), F.when(stem != "", stem).otherwise(c), test), parts))


def node_identifiers(label: Column, source: Column) -> Column:
    """What a node's label and file name."""
    words = F.filter(F.split(text(label), r"(?U)[\s,]+"), lambda w: w != "")
    pieces = F.filter(F.split(text(source), r"[/\\]"), lambda w: w != "")
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(text(label)), text(source)), words, pieces), lambda x: x != ""))


def ungrounded(prose: DataFrame, evidence: DataFrame, key: str = "community", estate: DataFrame | None = None) -> DataFrame:
    """(key, identifier) that the prose (key, text) claims and neither its own evidence (key, identifier) nor, where given, the estate's (identifier) holds.

    Spellings are many times the rows that Spark estimates from the evidence's files, so they are never broadcast.
    """
    claims = prose.select(key, F.explode(prose_identifiers(F.col("text"))).alias("identifier")).withColumn("norm", normalised(F.col("identifier"))).where("norm <> ''")
    own = evidence.select(key, F.explode(spellings(F.col("identifier"))).alias("s")).select(key, normalised(F.col("s")).alias("norm")).distinct()
    out = claims.join(own.hint("merge"), [key, "norm"], "left_anti")
    if estate is not None:
        wide = estate.select(F.explode(spellings(F.col("identifier"))).alias("s")).select(normalised(F.col("s")).alias("norm")).distinct()
        out = out.join(wide.hint("merge"), "norm", "left_anti")
    return out.select(key, "identifier")


def speculation(prose: DataFrame, key: str = "community") -> DataFrame:
    return prose.select(key, F.explode(matches(F.lower("text"), SPECULATION, 1)).alias("word"))


def verify(prose: DataFrame, evidence: DataFrame, carried: DataFrame, key: str = "community") -> DataFrame:
    """By origin (authored or carried), summaries, those with an ungrounded claim, and their share."""
    flagged = ungrounded(prose, evidence, key).select(key).distinct().withColumn("bad", F.lit(1))
    rows = prose.select(key).join(flagged, key, "left").join(carried.select(key).distinct().withColumn("c", F.lit(1)), key, "left")
    return rows.groupBy(F.when(F.col("c") == 1, "carried").otherwise("authored").alias("origin")).agg(F.count("*").alias("summaries"), F.count("bad").alias("flagged")).withColumn("share", F.col("flagged") / F.col("summaries"))


def sample_ids(ids: DataFrame, n: int, col: str = "id") -> DataFrame:
    """``n`` ids at even steps of their order by length, then text; the same ids again for the same input."""
    from .graph import with_rank

    total = ids.count()
    if n >= total:
        return ids.select(col)
    ranked = with_rank(ids.select(col), F.length(col), F.col(col), name="i")
    # the i-th pick is element floor(i * total / n): the elements at which that floor steps
    return ranked.where(F.floor((F.col("i") * n + n - 1) / total) * total / n < F.col("i") + 1).where(F.floor(F.floor((F.col("i") * n + n - 1) / total) * total / n) == F.col("i")).select(col)


def topic_nodes(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Nodes whose label or file has a keyword of a topic; keywords are a hand-written list."""
    words = topics.select("slug", F.explode("keywords").alias("k"))
    hay = F.lower(F.concat_ws(" ", text("label"), text("source_file")))
    return nodes.withColumn("_h", hay).join(bounded(words), F.col("_h").contains(F.col("k"))).drop("_h", "k").distinct()


def topic_dossier(nodes: DataFrame, links: DataFrame, degrees: DataFrame, topics: DataFrame, summaries: DataFrame | None = None, records: DataFrame | None = None) -> dict[str, DataFrame]:
    """By topic: twelve nodes a repository, twenty-five features, forty tickets one hop away, and, where given, twenty summaries and forty described tickets that have a keyword."""
    found = topic_nodes(nodes, topics).join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    per_repo = found.withColumn("rn", F.row_number().over(Window.partitionBy("slug", "repo").orderBy(F.desc("degree"), "label", "id"))).where("rn <= 12")
    features = top_per_group(found.where("kind IN ('feature', 'gherkin_feature')"), "slug", 25, F.desc("degree"), "label", "id")
    ends = links.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")).select("e.*")
    tickets = found.select("slug", "id").join(ends, "id").join(nodes.where("kind IN ('ticket', 'jira_ticket')").select(F.col("id").alias("other"), F.col("label").alias("ticket")), "other")
    counted = tickets.groupBy("slug", "ticket").agg(F.count_distinct("id").alias("n"))
    out = {"nodes": per_repo, "features": features, "tickets": top_per_group(counted, "slug", 40, F.desc("n"), "ticket")}
    words = bounded(topics.select("slug", F.explode("keywords").alias("k")))
    if summaries is not None:  # community, text
        said = summaries.join(words, F.lower("text").contains(F.col("k"))).select("slug", "community", "text").distinct()
        out["summaries"] = top_per_group(said, "slug", 20, "community")
    if records is not None:  # ticket, d, repos
        told = records.join(words, F.lower(F.array_join("d", " ")).contains(F.col("k"))).select("slug", "ticket", "d", "repos").distinct()
        out["described"] = top_per_group(told, "slug", 40, F.desc(F.size("repos")), "ticket")
    return out


def prose_gate(prose: DataFrame, known: DataFrame, least: int, most: int | None = None, key: str = "community", must: str | None = None) -> DataFrame:
    """Prose rows (key, text) with the reason each is refused, or an empty one: an unknown id, a length, a citation that is missing."""
    rows = prose.join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    n = F.length(F.trim(text("text")))
    reason = F.when(F.col("_known").isNull(), "unknown-id").when(n < least, "too-short")
    reason = reason if most is None else reason.when(n > most, "too-long")
    reason = reason if must is None else reason.when(~F.col("text").contains(must), "no-citation")
    return rows.withColumn("reason", reason.otherwise("")).drop("_known")

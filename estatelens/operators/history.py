"""Measures over the file-to-ticket index (repo, path, ticket, n): churn, co-change, hotspots, instability, timelines, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


def churn(index: DataFrame, *by: str) -> DataFrame:
    """Distinct tickets of each file."""
    return index.groupBy(*by).agg(F.count_distinct("ticket").alias("tickets"))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def cochange_pairs(index: DataFrame, least: int = DEFAULTS.dive_min_cochange, most_files: int = DEFAULTS.cochange_max_files, *, item: str = "path", group: str = "ticket") -> DataFrame:
    """(a, b, n), a < b: files that share at least ``least`` tickets. Tickets of more than ``most_files`` files are sweeping changes and pair nothing.

    The cap is the operator's own rule and bounds a ticket's pairs. Sizes are counted first, with map-side combine, so the files
    of a sweeping ticket are never gathered; pairs then come from the sorted file lists of the others.
    """
    pairs = index.select(group, item).distinct()
    fit = pairs.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(2, most_files))
    sets = pairs.join(fit.select(group), group, "left_semi").groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    pairs = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice(F.col("xs"), i + 2, F.greatest(F.size("xs") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hotspots(files: DataFrame, top_files: int = DEFAULTS.dive_top_files) -> DataFrame:
    """Of files (path, degree, tickets), those among the most churned whose degree is at least the third quartile: element floor(n * 3 / 4), from 0, of the positive degrees in order."""
    used = files.where("degree > 0")
    # a histogram of degrees stands for their sorted list, so nothing but distinct degrees meets in one place
    hist = used.groupBy("degree").agg(F.count("*").alias("n"))
    n = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bar, seen = None, 0
    for r in hist.orderBy("degree").toLocalIterator():
        seen += r["n"]
        if seen > int(n * 0.75):
            bar = r["degree"]
            break
    most = files.orderBy(F.desc("tickets"), "path").limit(top_files)
    return most.where(F.lit(False) if bar is None else F.col("degree") >= bar).where("degree > 0")


def instability(records: DataFrame, description: Column) -> DataFrame:
    """Shares of the tickets that speak of reverts and of fixes."""
    n = F.greatest(F.count("*"), F.lit(1))
    return records.agg(F.count("*").alias("described"), (F.sum(description.rlike(r"(?iU)\brevert").cast("int")) / n).alias("revert_share"), (F.sum(description.rlike(r"(?iU)\b(fix|defect|bug|hotfix)").cast("int")) / n).alias("fix_share"))


def timeline(records: DataFrame, first: str = "first") -> DataFrame:
    return records.where(f"{first} IS NOT NULL").groupBy(F.substring(F.col(first).cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("n"))


def coupling_surface(nodes: DataFrame, repo: str, suffix: str = ".json") -> DataFrame:
    """Labels with a suffix that a repository shares with others, and those others, by their number."""
    own = nodes.where((F.col("repo") == repo) & F.col("label").endswith(suffix)).select("label").distinct()
    others = nodes.where((F.col("repo") != repo) & (F.coalesce("repo", F.lit("")) != ""))
    return others.join(own, "label").groupBy("label").agg(F.array_sort(F.collect_set("repo")).alias("repos"), F.count_distinct("repo").alias("n"))


def scale(nodes: DataFrame, repo: str) -> DataFrame:
    """A repository's nodes, its share of all, and its communities."""
    mine = F.when(F.col("repo") == repo, 1)
    return nodes.agg(F.count(mine).alias("nodes"), (F.count(mine) / F.greatest(F.count("*"), F.lit(1))).alias("share"), F.count_distinct(F.when(F.col("repo") == repo, F.col("community"))).alias("communities"))


def features_of(features: DataFrame, index: DataFrame, repo: str) -> DataFrame:
    """Features (id, label, tickets) with a ticket that touches the repository, and those tickets."""
    mine = index.where(F.col("repo") == repo).select("ticket").distinct()
    return features.select("id", "label", F.explode("tickets").alias("ticket")).join(mine, "ticket").groupBy("id", "label").agg(F.array_sort(F.collect_set("ticket")).alias("tickets"))


def test_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, test): a file and the one with its stem and `Test` at the end."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    a = files.select(F.col(path).alias("path"), stem.alias("stem"))
    return a.join(a.select(F.col("path").alias("test"), F.regexp_extract("stem", "^(.+)Test$", 1).alias("stem")).where("stem <> ''"), "stem").select("path", "test")


def authors(commits: DataFrame, k: int = 20) -> DataFrame:
    """A repository's most frequent authors: count descending, then the name in lower case."""
    from pyspark.sql import Window

    n = commits.groupBy("repository", F.col("author.name").alias("author")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("n"), F.lower("author"), "author"))).where(F.col("rank") <= k)


def exported(commits: DataFrame) -> DataFrame:
    """(repository, n, newest): how many commits an exported history has, and the date of its newest."""
    return commits.groupBy("repository").agg(F.count("*").alias("n"), F.max("author_date").alias("newest"))


def commits_by_year(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repository", F.substring("author_date", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def dive_bundle(nodes: DataFrame, index: DataFrame, records: DataFrame, features: DataFrame, degrees: DataFrame, repo: str, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """All measures of one repository, by name."""
    mine = index.where(F.col("repo") == repo)
    described = records.join(mine.select("ticket").distinct(), "ticket")
    files = churn(mine, "path")
    file_degree = nodes.where(F.col("repo") == repo).join(degrees, "id").groupBy(F.col("source_file").alias("path")).agg(F.sum("degree").alias("degree"))
    return {
        "scale": scale(nodes, repo),
        "churn": top(files, settings.dive_top_files, F.desc("tickets"), "path"),
        "hotspots": hotspots(files.join(file_degree, "path", "left").fillna(0, ["degree"]), settings.dive_top_files),
        "cochange": top(cochange_pairs(mine, settings.dive_min_cochange, settings.cochange_max_files), 25, F.desc("n"), "a", "b"),
        "instability": instability(described, F.array_join("d", " ")),
        "timeline": timeline(described),
        "coupling": top(coupling_surface(nodes, repo), 20, F.desc("n"), "label"),
        "features": top(features_of(features, index, repo), 15, F.desc(F.size("tickets")), "label", "id"),
        "tests": test_pairs(files),
    }

"""Which repositories make the estate: listings of a code host, filters, and the files that record the choice."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import selected
from .schemas import S, struct

LISTING = struct(name=S, defaultBranch=S)


def parse_listing(spark: SparkSession, output: str) -> DataFrame:
    """A listing (one JSON object a line; blank lines aside) as (name, defaultBranch)."""
    rows = [(x.get("name"), x.get("defaultBranch")) for x in map(json.loads, filter(str.strip, output.splitlines()))]
    return spark.createDataFrame(rows, LISTING)


def listing_command(org: str, team: str | None = None) -> list[str]:
    """Arguments of the host's CLI that list what isn't archived, in pages, filtered where it is."""
    where = f"/orgs/{org}/teams/{team}/repos?per_page=100" if team else f"/orgs/{org}/repos?per_page=100&type=all"
    return ["api", "--paginate", where, "--jq", ".[] | select(.archived==false) | {name, defaultBranch: .default_branch}"]


def discover(spark: SparkSession, rules: Iterable[tuple[str, str]], org: str, runner: Callable[[list[str]], str]) -> DataFrame:
    """(name, defaultBranch, place) of the repositories that rules select; those to fetch only are external. A name that several rules select is there once."""
    rules = list(rules)
    found = selected(parse_listing(spark, runner(listing_command(org))), rules).withColumn("turn", F.lit(0))
    gone = [v for k, v in rules if k == "exclude"]
    for i, team in enumerate((v for k, v in rules if k == "team"), 1):
        more = parse_listing(spark, runner(listing_command(org, team)))
        found = found.unionByName((more.where(~F.col("name").isin(*gone)) if gone else more).withColumn("turn", F.lit(i)))
    one = found.groupBy("name").agg(F.min_by("defaultBranch", "turn").alias("defaultBranch"))
    fetch = [v for k, v in rules if k == "fetch"]
    return one.withColumn("place", F.when(F.col("name").isin(*fetch), "external").otherwise("estate") if fetch else F.lit("estate"))


def config_lines(repos: DataFrame, org: str) -> DataFrame:
    """(name, line) of the repository list."""
    return repos.select("name", F.format_string(f"%s|git@github.com:{org}/%s.git|%s", "name", "name", "defaultBranch").alias("line"))


def symlink_outcomes(links: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """By repository and outcome, symbolic links (repo, path, target: null if broken, inside: whether the target is in the corpus) that an extractor would read.

    A link to a collected file duplicates it; one to anything else misattributes what it shows. Excluded paths are taken out before.
    """
    ends = lambda c: F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1)).isin(*suffixes)
    rows = links.where(ends("path") & ~F.array_contains(F.split("path", "/"), ".git"))
    outcome = F.when(F.col("target").isNull(), "broken").when(F.col("inside") & ends("target"), "duplicating").otherwise("misattributing")
    return rows.groupBy("repo", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def uncached(paths: DataFrame, cached: DataFrame) -> DataFrame:
    return paths.join(cached.select("path"), "path", "left_anti")


def store_relative(path, root: str):
    """A path below ``root`` without it, as it is kept at rest; others as they are."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def absolute(path, root: str):
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

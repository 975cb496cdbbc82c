"""The state of a store as one frame: every check is ok, a finding, or unknown, and unknown never counts as ok."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text


def report(spark: SparkSession, checks: Mapping[str, DataFrame | None]) -> DataFrame:
    """(check, state, findings) of named findings; None is a check that couldn't be made. Each frame is counted, none is collected."""
    out = spark.createDataFrame([(k, "unknown", None) for k, df in checks.items() if df is None], "check string, state string, findings long")
    for k, df in checks.items():
        if df is not None:
            n = df.agg(F.count("*").alias("findings"))
            out = out.unionByName(n.select(F.lit(k).alias("check"), F.when(F.col("findings") > 0, "finding").otherwise("ok").alias("state"), "findings"))
    return out


def exit_code(rows: DataFrame, *, strict: bool = False, failing: tuple[str, ...] = ()) -> int:
    """1 if a check named in ``failing`` has findings, or, when strict, if any has."""
    bad = rows.where("state = 'finding'")
    bad = bad if strict else bad.where(F.col("check").isin(*failing)) if failing else bad.where(F.lit(False))
    return int(bad.limit(1).count() > 0)


def gate_code(declared: DataFrame | None, passed: DataFrame) -> int:
    """2 if there was nothing to judge by (no questions or no answers), 1 if a mode's floor is broken (``gate`` rows), else 0."""
    if declared is None or not declared.limit(1).count():
        return 2
    return int(passed.where("floor_broken").limit(1).count() > 0)


def layer_coverage(**layers: tuple[DataFrame, DataFrame]) -> dict[str, tuple[int, int]]:
    """Written and expected numbers of each named layer."""
    return {k: (written.count(), expected.count()) for k, (written, expected) in layers.items()}


def intent_coverage(index: DataFrame, recorded: DataFrame) -> DataFrame:
    """Repositories that the index has files of, of those recorded."""
    mined = index.select(F.col("repo").alias("name")).distinct().withColumn("_m", F.lit(1))
    return recorded.select("name").distinct().join(mined, "name", "left").agg(F.count("_m").alias("mined"), F.count("*").alias("estate"))


def unmined(index: DataFrame, recorded: DataFrame) -> DataFrame:
    return recorded.select("name").distinct().join(index.select(F.col("repo").alias("name")), "name", "left_anti")


def dangling_citations(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Cited files that no listing of the store has."""
    cited = nodes.where(text("source_file") != "").select(F.col("source_file").alias("path")).distinct()
    return cited.join(paths.select("path"), "path", "left_anti")


def figure(report_text: Column, what: str) -> Column:
    """The first count that a report states, such as `12,345 nodes`; null if it states none."""
    found = F.regexp_extract(report_text, r"(\d[\d,]*) " + what, 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).cast("long"))


def stale(report_at: Column, graph_at: Column) -> Column:
    """Whether a report is known to be older than its graph, by instants."""
    return F.coalesce(F.try_to_timestamp(report_at) < F.try_to_timestamp(graph_at), F.lit(False))


def claims_differ(claims: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The figures (nodes, edges) that a report claims beside those of the graph, where they differ."""
    real = nodes.agg(F.count("*").alias("n")).crossJoin(links.agg(F.count("*").alias("m")))  # one row each
    return claims.crossJoin(real).where("NOT (nodes <=> n) OR NOT (edges <=> m)")


def behind(drift: DataFrame) -> DataFrame:
    """Repositories (repo, behind) that are behind their source, most first."""
    return drift.where("behind > 0").orderBy(F.desc("behind"), "repo")


def partitioner_gap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Counts of two graph files (nodes, communities, clustered) where they disagree."""
    a = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("figure", "here"))
    b = other.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, other.columns)), F.array(*other.columns))).alias("figure", "there"))
    return a.join(b, "figure").where("NOT (here <=> there)")

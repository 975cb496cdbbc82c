"""Stand-ins: the test tables hold no commits or code, so parts play files and nodes, orders tickets, suppliers features, documents bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import searchable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from a part to a supplier for each line item."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("repo"), F.concat(F.lit("src/"), F.lower("p_type")).alias("source_file"), F.col("p_size").cast("long").alias("community"),
        F.when(F.col("p_partkey") % 7 == 0, "doc").otherwise("code").alias("file_type"), F.when(F.col("p_partkey") % 50 == 0, "gherkin_scenario").alias("kind"), F.when(F.col("p_partkey") % 90 == 0, "package").alias("type"), F.col("p_partkey").alias("pos"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("nation-"), "s_nationkey").alias("repo"), F.concat(F.lit("features/"), "s_nationkey").alias("source_file"), F.col("s_nationkey").cast("long").alias("community"),
        F.lit("code").alias("file_type"), F.when(F.col("s_suppkey") % 10 == 0, "feature").alias("kind"), F.lit(None).cast("string").alias("type"), (F.col("s_suppkey") + 10_000_000).alias("pos"),
    )
    return part.unionByName(supplier)


LINKS_SQL = "SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem"
NODES_SQL = """
SELECT 'p' || p_partkey AS id, p_name AS label, p_brand AS repo, 'src/' || lower(p_type) AS source_file, CAST(p_size AS BIGINT) AS community,
       CASE WHEN p_partkey % 7 = 0 THEN 'doc' ELSE 'code' END AS file_type, CASE WHEN p_partkey % 50 = 0 THEN 'gherkin_scenario' END AS kind,
       CASE WHEN p_partkey % 90 = 0 THEN 'package' END AS type, CAST(p_partkey AS BIGINT) AS pos FROM part
UNION ALL
SELECT 's' || s_suppkey, s_name, 'nation-' || s_nationkey, 'features/' || s_nationkey, CAST(s_nationkey AS BIGINT), 'code',
       CASE WHEN s_suppkey % 10 = 0 THEN 'feature' END, NULL, s_suppkey + 10000000 FROM supplier
"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, ticket, day): a part, an order and the order's date, as a date, so that its least and greatest are hash-aggregated."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket"), F.to_date("o_orderdate").alias("day"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("ticket")).join(orders, "ticket")


INDEX_SQL = "SELECT l_partkey AS path, l_orderkey AS ticket, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search entries; the key is their rank."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("eid"), F.col("p_name").alias("label"), F.col("p_brand").alias("repo"), F.col("p_type").alias("source_file"), F.lit("code").alias("kind"), F.col("p_size").cast("long").alias("community"))
    return searchable(part)


ENTRIES_SQL = "SELECT p_partkey AS eid, p_name AS label, p_brand AS repo, p_type AS source_file, CAST(p_size AS BIGINT) AS community, lower(p_name) AS l, lower(p_type) AS src, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay FROM part"

"""A corpus pipeline of the training-data operators: documents in, a decontaminated mixture out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import DOCUMENT_COLUMNS, only, table, written
from estatelens.llm.decontaminate import decontaminate
from estatelens.llm.line_dedup import dedup_lines
from estatelens.llm.mixing import mix
from estatelens.llm.similar import similar_dedup
from estatelens.llm.toxicity import fitted, score_toxicity


def recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half stay."""
    return score_toxicity(docs, fitted(spark, docs, sf_dir)).where("score < 0.5").select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that other documents repeat; a text may become empty."""
    return recounted(dedup_lines(docs, out_col="text"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    SimHash fingerprints and their vantage-point trees find links first; all links are of 5-word shingle sets of similarity 0.8,
    and those between fingerprints further apart come from shared minima.
    """
    return similar_dedup(docs).select(*DOCUMENT_COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; all documents stay."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), drop=("text",))
    return recounted(out.withColumn("text", F.col("clean_text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at its place in the mixture of the sources."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Aho-Corasick scores, suffix positions and SimHash components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each one's rows written to the shared folder for the next, and deleted when that has been written.

    Null, empty and very long texts, null and repeated ids, empty tables and other columns of ``documents`` give what the
    stages' operators say: a row is dropped by its toxicity or as a surplus copy alone, a null text becomes an empty one, and only
    the columns of documents go on.
    """
    docs, since = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS), len(written)
    for _, stage in STAGES[:-1]:
        docs = only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), since)
    return STAGES[-1][1](spark, docs, sf_dir)

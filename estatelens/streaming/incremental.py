"""Incremental forms of batch operators with Structured Streaming: commit counts as commits arrive, and caches kept by upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tickets_of
from ..sources.schemas import COMMIT


def commit_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Commits as their NDJSON files arrive, each sha of a repository once within the watermark."""
    raw = spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withColumn("at", F.to_timestamp("committer_date")).withWatermark("at", "30 days").dropDuplicatesWithinWatermark(["repository", "sha"])


def file_ticket_counts(commits: DataFrame) -> DataFrame:
    """(repo, path, ticket, n, first, last) of subjects' tickets; a stream in gives a stream out, in update mode."""
    rows = commits.where("NOT coalesce(is_merge, false)").select(F.col("repository").alias("repo"), F.explode("files.path").alias("path"), tickets_of(F.col("subject")).alias("tickets"), F.substring("author_date", 1, 10).alias("day"))
    return rows.select("repo", "path", F.explode("tickets").alias("ticket"), "day").groupBy("repo", "path", "ticket").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def upserting(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Folds each batch of a stream into a Parquet table by ``merge(table, batch)``.

    Each batch's table goes to a numbered folder, made from the one before, so a batch that is done again gives the same; the
    folder before that is deleted, so there are two at most. The table is what the batches amount to (a cache, counts), not
    the stream: a table that grows with the stream belongs in a format that merges in place.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{table}/v={number - 1}") if number else spark.createDataFrame([], batch.schema)
        merge(before, batch).write.mode("overwrite").parquet(f"{table}/v={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(fold).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Event counts by time window, with late data up to a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))

"""Shared plumbing of the training-data operators: reading, cutting lineage, Arrow passes, bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch and its bytes at most, so that a Python worker holds some tens of MB of text at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: No single broadcast is larger; what is larger goes in several passes.
BROADCAST_BYTES = 32 << 20

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of ``sf_dir``, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where none is set (tests, a single machine) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


#: Folders that this process has written to the shared folder.
written: list[str] = []


def remove_written(since: int = 0, keep: int = 0) -> None:
    """Deletes what ``cut`` wrote from the ``since``-th folder on, but for the last ``keep``, by the store's own file system.

    Called where nothing that is still to run reads those folders, and for all of them when the driver ends, while its session lives.
    """
    spark = SparkSession.getActiveSession()
    gone = written[since : len(written) - keep]
    with contextlib.suppress(Py4JError, OSError):  # the session may be gone with its store
        if spark is not None:
            for folder in gone:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                written.remove(folder)


@cache
def register() -> None:
    """Once, and after the session has registered its own end, so that ``remove_written`` comes first."""
    atexit.register(remove_written)


def only(make: Callable[[], DataFrame], since: int | None = None) -> DataFrame:
    """``cut`` of what ``make`` returns; whatever else ``make`` has cut (or was, from the ``since``-th folder on) is deleted, as the result no longer reads it."""
    since = len(written) if since is None else since
    out = cut(make())
    remove_written(since, 1)
    return out


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` without the rows whose ``keys`` are in ``gone`` (cut, of two longs a row). Whole rows are shuffled only if ``gone`` is too large to send."""
    on = [F.col(k) == F.col(f"__gone_{k}") for k in keys]
    gone = gone.toDF(*[f"__gone_{k}" for k in keys])
    small = gone.count() * 64 <= BROADCAST_BYTES
    return df.join(F.broadcast(gone) if small else gone.hint("shuffle_hash"), on, "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later plans start there, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    register()
    written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def annotate(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., list[pa.Array]]], fields: Sequence[T.StructField], drop: Sequence[str] = ()) -> DataFrame:
    """One narrow Arrow pass that adds ``fields`` to the rows of ``df``.

    ``make`` is called once for each task and returns a function from the arrays of ``inputs`` to the arrays of ``fields``.
    Columns named in ``drop``, and columns whose name clashes (in any case) with a new one, are left out of the result.
    """
    arrow_limits(df.sparkSession)
    gone = {f.name.lower() for f in fields} | {x.lower() for x in drop}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept] + [f.name for f in fields]
    clash = [f for f in df.schema.fields if f.name.lower() in gone and f.name not in inputs]
    if clash:
        df = df.drop(*[f.name for f in clash])
    at_in = [df.columns.index(x) for x in inputs]
    at_kept = [df.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at_kept), *work(*(b.column(i) for i in at_in))], names=names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, T.StructType([*kept, *(T.StructField(f.name, f.dataType, True) for f in fields)]))


def byte_texts(col: pa.Array) -> list[bytes | None]:
    """The rows of a string column as UTF-8 bytes, without decoding them."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def blocks(rows: DataFrame, size: str, limit: int = BROADCAST_BYTES, weight: int = 2) -> tuple[int, Iterator[list]]:
    """How many blocks of at most about ``limit`` bytes ``rows`` make, and the blocks, one at a time on the driver.

    ``size`` is an SQL expression of a row's bytes; ``weight`` times it is what the row takes on the driver. A table
    within the limit, even an empty one, is one block.
    """
    total = rows.agg(F.sum(F.expr(size)).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) * weight // limit))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(n))
    return n, (rows.collect() if n == 1 else rows.where(part == i).collect() for i in range(n))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges`` (pairs of long node ids), as rows (node, root); root is the smallest id of the component.

    Alternates the large-star and small-star steps until no edge changes. Every step is an aggregation with map-side
    combine and a join whose skewed partitions Spark can split; nothing but a checksum of the edges reaches the driver.
    Nodes without edges don't appear. Self-links and nulls are dropped.
    """

    def orient(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    since = len(written)
    e = cut(orient(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()))
    before = mark(e)
    while before[0]:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = orient(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = cut(orient(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))))
        remove_written(since, 1)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())

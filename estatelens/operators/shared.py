"""Frames written to the folder that all executors share, so that what follows starts there and a lost executor costs a reread only."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import cache

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where none is set, and on a local master, a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Py4JError, OSError):  # the session may be gone with its store
        while spark is not None and _written:
            _delete(spark, _written.pop())


@cache
def _register() -> None:
    """Once, after the session has registered its own end, so that the folders go first."""
    atexit.register(_remove)


def new_folder(spark: SparkSession) -> str:
    """The name of a folder below the shared one, which is deleted when the driver ends."""
    _register()
    _written.append(f"{shared_folder(spark)}/made-{uuid.uuid4().hex}")
    return _written[-1]


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what ``durable`` wrote for ``df``, which nothing that is still to run may read."""
    for folder in [f for f in _written if any(f"/{f.rsplit('/', 1)[-1]}/" in x for x in df.inputFiles())]:
        _delete(df.sparkSession, folder)
        _written.remove(folder)

"""Session construction and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on its way to or from Python, more or less.
BATCH = "4m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    _BATCH_KEY: BATCH,
}


def get_session(app: str = "rubricon", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about ``BATCH`` bytes, unless the session has a bound
    of its own. Spark's default is by rows: 10 000 whole texts are tens of megabytes, which the executor
    and its Python worker each hold, some steps several times over."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where the
    executors share the driver's disk, a private temporary folder may stand in for it.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rubricon-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete all intermediate tables that this application has stored. Call it when the results
    that were built on them have been written."""
    _delete(spark, _own_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stored`` whose tables are deleted together at the end of the block.

    What leaves the block must not read them: store it outside."""
    folder = shared_path(spark, "scratch")

    def put(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    try:
        yield put
    finally:
        _delete(spark, folder)


def durable(df):
    """Cut lineage through reliable storage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write a costly intermediate table once to the shared folder and read it back, so that
    later passes prune columns and lost executors repeat nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

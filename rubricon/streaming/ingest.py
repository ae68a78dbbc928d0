"""Incremental page ingestion: a landing folder of page files to index tables.

Pages whose url is indexed already are skipped. Every micro-batch writes its own
``batch=<n>`` folder with overwrite, so a batch that is run again after a failure leaves the
same tables behind. Pages that miss the prefix share wait in ``retry``; each run takes them up
again before it reads what has landed, in batches numbered down from -1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rubricon.operators.grouping import first_by
from rubricon.operators.index import url_key
from rubricon.plans.build_index import KEY, build_index
from rubricon.session import stored

PAGES = "page_id long, url string, html string"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of all batches, empty where none has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def indexed_keys(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """Url keys written by batches before ``before``."""
    return _written(spark, f"{folder}/texts", f"{KEY} string").where(F.col("batch") < before).select(KEY)


def waiting_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that no batch has indexed, each url as it landed last."""
    pages = _written(spark, f"{folder}/retry", PAGES)
    last = first_by(pages.withColumn(KEY, url_key(F.col("url"))), [KEY], [-F.col("batch"), F.col("page_id")])
    done = _written(spark, f"{folder}/texts", f"{KEY} string").select(KEY)
    return last.join(done, KEY, "left_anti").select("page_id", "url", "html")


def retry(spark: SparkSession, folder: str, contexts: Callable[[DataFrame], DataFrame]) -> int:
    """Index the waiting pages whose prefixes suffice now; how many documents that published.

    The batch has the number below those that are complete, so that a run after a failure repeats it.
    """
    pages = stored(waiting_pages(spark, folder), "waiting")
    if pages.isEmpty():
        return 0
    least = _written(spark, f"{folder}/texts", f"{KEY} string").agg(F.min("batch")).first()[0]
    batch = min(least if least is not None else 0, 0) - 1
    return write_batch(pages, batch, folder, contexts, waiting=True)


def write_batch(
    pages: DataFrame, batch: int, folder: str, contexts: Callable[[DataFrame], DataFrame] | None = None, waiting: bool = False
) -> int:
    """Index one batch; how many documents it published. With a context step, chunks of documents that
    miss the prefix share go to ``quarantine`` instead of ``chunks`` and their pages to ``retry``, where
    pages that are ``waiting`` are already."""
    spark = pages.sparkSession
    # What waited and was published meanwhile is done for pages of any batch.
    tables = build_index(pages, indexed_keys(spark, folder, batch), contexts)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    put(tables["publish"], "publish")
    kept = tables["publish"].where("publish" if contexts else "true").select(KEY)
    if contexts:
        put(tables["chunks"].join(kept, KEY, "left_anti"), "quarantine")
        if not waiting:
            named = tables["texts"].join(kept, KEY, "left_anti").select("url")
            put(pages.join(named, "url", "left_semi").select("page_id", "url", "html"), "retry")
    for name in ("metadata", "chunks", "postings", "terms", "corpus", "texts"):
        # The key list of texts comes last: a batch without it counts as not done.
        put(tables[name].join(kept, KEY, "left_semi"), name)
    return kept.count()


def ingest(
    spark: SparkSession,
    landing: str,
    folder: str,
    checkpoint: str,
    contexts: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Take up the pages that wait, then start a query that indexes all that has landed and stops."""
    if contexts:
        retry(spark, folder, contexts)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return (
        pages.writeStream.foreachBatch(lambda df, n: write_batch(df, n, folder, contexts) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Answering a table of queries from chunk tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.operators import retrieval
from rubricon.plans.build_index import KEY
from rubricon.session import stored


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    scope: str,
    vectors: DataFrame,
    query_vectors: DataFrame,
    rerank_scores: Callable[[DataFrame], DataFrame],
    document_order: bool = False,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Context text per query, from the chunks of the query's scope only.

    ``chunks(<scope>, chunk_id, text)``, ``queries(<scope>, query_id, text)``,
    ``vectors(<scope>, chunk_id, vector)``, ``query_vectors(query_id, vector)``. ``rerank_scores``
    turns candidates ``(<scope>, query_id, chunk_id, ...)`` into ``(query_id, chunk_id,
    rerank_score)``. Candidates are stored before they are scored, so that a model is asked once.
    ``tables`` are those of ``lexical_tables``.
    """
    scopes = queries.select(scope, "query_id")
    tables = tables or retrieval.lexical_tables(chunks, scope)
    fused = retrieval.fuse(
        [
            retrieval.lexical_channel(chunks, queries, scope, tables=tables),
            retrieval.dense_channel(vectors, query_vectors.join(scopes, "query_id"), scope=scope),
            retrieval.verbatim_channel(chunks, queries, scope, tables=tables),
        ]
    )
    candidates = stored(fused.join(scopes, "query_id"), "candidates")
    top = retrieval.rerank(candidates, rerank_scores(candidates)).withColumnRenamed("chunk_id", "chunk_idx")
    merged = retrieval.passages(top, document_order).join(scopes, "query_id")
    texts = chunks.select(scope, F.col("chunk_id").alias("chunk_idx"), "text")
    return retrieval.context_text(merged, texts, [scope, "chunk_idx"])


def retrieve_from_index(
    index: dict[str, DataFrame],
    queries: DataFrame,
    vectors: DataFrame,
    query_vectors: DataFrame,
    rerank_scores: Callable[[DataFrame], DataFrame],
    document_order: bool = False,
) -> DataFrame:
    """Context text per query from the tables of ``build_index``.

    ``queries(url_key, query_id, text)`` name their document; ``vectors(url_key, chunk_idx, vector)``.
    """
    named = lambda df: df.withColumn("chunk_id", F.col("chunk_idx").cast("long")).drop("chunk_idx")
    chunks = named(index["chunks"].select(KEY, "chunk_idx", "text"))
    tables = retrieval.lexical_tables(chunks, KEY, named(index["postings"]), index["corpus"])
    return retrieve(chunks, queries, KEY, named(vectors), query_vectors, rerank_scores, document_order, tables)

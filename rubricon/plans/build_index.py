"""Page index: from raw pages to chunks, metadata and retrieval statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import document_sample
from rubricon.operators import index
from rubricon.session import stored

KEY = "url_key"


def build_index(
    pages: DataFrame,
    done: DataFrame | None = None,
    contexts: Callable[[DataFrame], DataFrame] | None = None,
    least: int | None = None,
) -> dict[str, DataFrame]:
    """``pages(page_id, url, html)`` to index tables keyed by url hash.

    ``contexts`` writes prefixes ``(url_key, chunk_idx, prefix)`` for chunk rows, usually a
    model step; without it chunks go unprefixed and the publish flags say so. With ``least``, a page
    whose blocks give fewer chunks, or none, is split from its plain text instead. Chunks say whether the
    even sample of ``CHUNK_CAP`` a page has them (``sampled``) and whether the index of their page may be
    kept (``publish``); none is left out. Pages are parsed
    and split once each, and prefixes written once; the results are kept in the shared folder for the later passes.
    """
    fresh = index.unseen_pages(pages, done)
    parsed = stored(index.page_text_and_blocks(fresh), "parsed-pages")
    texts = parsed.select(KEY, "url", "raw_text")
    chunks = stored(index.document_chunks(index.labelled_text(parsed), KEY, least), "page-chunks")
    meta = texts.select(
        KEY, "url", *index.filing_metadata(F.col("raw_text")), document_sample(F.col("raw_text")).alias("summary_input")
    )
    # Stored, so that a model is asked once whatever is read from the result.
    prefixes = (
        stored(contexts(chunks), "prefixes")
        if contexts
        else chunks.select(KEY, "chunk_idx", F.lit("").alias("prefix"))
    )
    enriched = index.with_prefixes(chunks, prefixes, KEY)
    publish = index.publishable(enriched, KEY)
    return {
        "texts": texts,
        "metadata": meta,
        "chunks": index.gated(enriched.join(meta.select(KEY, "filing_type", "period"), KEY), publish, KEY, index.CHUNK_CAP),
        "publish": publish,
        "postings": index.postings(enriched, [KEY, "chunk_idx"]),
        "terms": index.term_stats(enriched, [KEY]),
        "corpus": index.corpus_stats(enriched, [KEY]),
    }

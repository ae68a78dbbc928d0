"""From pages to labelled, sampled and counted chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.html import parse_page, table_markdown
from rubricon.functions.splitting import WINDOW_OVERLAP, WINDOW_WORDS, make_splitter
from rubricon.functions.text import (
    SPACE,
    filing_period,
    filing_type,
    is_section_line,
    section_name,
    tokens,
    trim_space,
    url_key,
)
from rubricon.operators.grouping import exploded

# Least block length, length from which repeats are dropped, caps.
BLOCK_CHARS, REPEAT_CHARS = 40, 500
CHUNK_CAP, SPARSE_CHUNKS = 2000, 50
PREFIX_SHARE = 0.5
FIRST_SECTION = "PREAMBLE"


def unseen_pages(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """First capture of every url that has no index yet, keyed by the url hash. ``page_id`` is
    unique. Which pages stay is decided on ids and hashes alone; the page bodies take part in
    one join only."""
    narrow = pages.select("page_id", url_key(F.col("url")).alias("url_key"))
    if done is not None:
        narrow = narrow.join(done.select("url_key").distinct(), "url_key", "left_anti")
    return pages.join(narrow.groupBy("url_key").agg(F.min("page_id").alias("page_id")), "page_id")


def page_text_and_blocks(pages: DataFrame) -> DataFrame:
    """Plain text and block array per page. A page is one row, so blocks never outgrow
    the cell they came from."""
    parsed = pages.withColumn("_p", parse_page(F.col("html")))
    text = lambda b: F.when(b["tag"] == "table", table_markdown(b["cells"])).otherwise(b["text"])
    return parsed.select(
        *[c for c in pages.columns if c != "html"],
        F.col("_p.text").alias("raw_text"),
        F.transform("_p.blocks", lambda b: F.struct(b["tag"].alias("tag"), text(b).alias("text"))).alias("blocks"),
    )


def block_rows(parsed: DataFrame, key: str) -> DataFrame:
    return exploded(parsed, [key], F.col("blocks"), "block_idx", "_b").select(
        key, "block_idx", F.col("_b.tag").alias("tag"), F.col("_b.text").alias("text")
    )


def long_enough(blocks: DataFrame, least: int = BLOCK_CHARS) -> DataFrame:
    return blocks.where(F.length("text") >= least)


def sectioned(blocks: DataFrame, key: str) -> DataFrame:
    """Label blocks with the section line before them and remove the section lines.

    Sections become ranges ``[start, next start)`` from the few section lines only; a
    block finds its range by bucket of block positions, so a long document is never
    sorted in one task.
    """
    width = 4096
    lines = blocks.where(is_section_line(F.col("text"))).select(
        key, "block_idx", section_name(F.col("text")).alias("section")
    )
    # Last section line at or before the start of each bucket, from bucket maxima.
    tagged = blocks.select(key, F.floor(F.col("block_idx") / width).alias("_bkt")).distinct()
    last_line = lines.groupBy(key, F.floor(F.col("block_idx") / width).alias("_bkt")).agg(
        F.max_by("section", "block_idx").alias("_last")
    )
    carried = tagged.join(last_line, [key, "_bkt"], "left").withColumn(
        "_carry",
        F.last("_last", ignorenulls=True).over(
            Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    inside = (
        blocks.withColumn("_bkt", F.floor(F.col("block_idx") / width))
        .withColumn("_header", F.when(is_section_line(F.col("text")), section_name(F.col("text"))))
        .withColumn(
            "_local",
            F.last("_header", ignorenulls=True).over(
                Window.partitionBy(key, "_bkt")
                .orderBy("block_idx")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .where(F.col("_header").isNull())
    )
    return inside.join(carried.select(key, "_bkt", "_carry"), [key, "_bkt"]).select(
        *blocks.columns, F.coalesce("_local", "_carry", F.lit(FIRST_SECTION)).alias("section")
    )


def without_repeats(blocks: DataFrame, key: str, longer_than: int = REPEAT_CHARS) -> DataFrame:
    """Drop later copies of a long block within its document; short repeats stay."""
    long = F.length("text") > longer_than
    first = (
        blocks.where(long).groupBy(key, F.md5("text").alias("_h")).agg(F.min("block_idx").alias("block_idx"))
    )
    return blocks.where(~long).unionByName(
        blocks.where(long).join(first.drop("_h"), [key, "block_idx"], "left_semi")
    )


def without_adjacent_repeats(blocks: DataFrame, key: str) -> DataFrame:
    """Drop a block equal to the one before it, that is at the index before. Blocks meet in buckets of
    positions, so they are moved once and a long document is never sorted in one task; the last block
    of a bucket visits the next one too. Where positions repeat, a block stays once for each differing
    block before it."""
    width = 4096
    at, bucket = F.col("block_idx").cast("long"), F.floor(F.col("block_idx") / width)
    placed = F.col(key).isNotNull() & at.isNotNull()
    # Blocks without a place have none before them; they are dealt by their text.
    last = placed & (F.pmod(at, F.lit(width)) == width - 1)
    buckets = F.when(last, F.array(bucket, bucket + 1)).when(placed, F.array(bucket)).otherwise(F.array(F.xxhash64("text")))
    rows = blocks.withColumn("_bkt", F.explode(buckets))
    before = Window.partitionBy(key, "_bkt").orderBy("block_idx").rangeBetween(-1, -1)
    rows = rows.withColumn("_before", F.collect_list(F.struct("text")).over(before))
    own = ~placed | (F.floor(at / width) == F.col("_bkt"))
    differs = lambda x: x["text"].isNull() | F.coalesce(x["text"] != F.col("text"), F.lit(False))
    times = F.when(~placed | (F.size("_before") == 0), 1).otherwise(F.size(F.filter("_before", differs)))
    rest = [c for c in blocks.columns if c not in (key, "block_idx")]
    rows = rows.where(own).withColumn("_times", times).where("_times > 0")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(key, "block_idx", *rest)


def labelled_text(parsed: DataFrame) -> DataFrame:
    """Add ``text``: the cleaned blocks of each page under their section labels.

    A page's blocks are an array in its own row, so the section of a block, the removal of
    section lines and the removal of later copies of long blocks are array work inside the row
    and nothing is shuffled. ``sectioned`` and ``without_repeats`` do the same for block tables.
    Copies are found by sorting the hashes of long blocks and comparing neighbours.
    """
    item = lambda idx, section, text: F.struct(idx.alias("idx"), section.alias("section"), text.alias("text"))
    head = lambda t: F.when(is_section_line(t), section_name(t))
    numbered = F.transform(
        "blocks", lambda b, i: F.struct(i.alias("idx"), head(b["text"]).alias("head"), b["text"].alias("text"))
    )
    is_long = lambda x: F.length(x["text"]) > REPEAT_CHARS
    rows = parsed.withColumn("_b", F.filter(numbered, lambda x: F.length(x["text"]) >= BLOCK_CHARS))
    rows = rows.withColumn("_h", F.filter("_b", lambda x: x["head"].isNotNull()))

    def section(x):
        before = F.filter("_h", lambda h: h["idx"] < x["idx"])
        return F.coalesce(F.try_element_at(before, F.lit(-1))["head"], F.lit(FIRST_SECTION))

    body = F.filter("_b", lambda x: x["head"].isNull())
    rows = rows.withColumn("_t", F.transform(body, lambda x: item(x["idx"], section(x), x["text"])))
    hashed = F.transform(F.filter("_t", is_long), lambda x: F.struct(F.md5(x["text"]).alias("h"), x["idx"], x["section"], x["text"]))
    rows = rows.withColumn("_l", F.array_sort(hashed))
    new = lambda x, i: (i == 0) | (F.get("_l", i - 1)["h"] != x["h"])
    kept = F.transform(F.filter("_l", new), lambda x: item(x["idx"], x["section"], x["text"]))
    clean = F.array_sort(F.concat(F.filter("_t", lambda x: ~is_long(x)), kept))
    label = lambda x: F.concat(F.lit("[SECTION: "), x["section"], F.lit("]\n"), x["text"])
    return rows.select(*parsed.columns, F.array_join(F.transform(clean, label), "\n\n").alias("text"))


def chunk_rows(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    split = make_splitter()
    return exploded(texts, [key], split(F.col(column)), "chunk_idx", "text")


def word_window_rows(
    texts: DataFrame, key: str, column: str = "text", size: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP
) -> DataFrame:
    """Word windows with overlap; a text of at most ``size`` words stays as it is."""
    stride = size - overlap
    cut = texts.select(
        key,
        F.col(column).alias("_t"),
        F.filter(F.split(F.col(column), f"{SPACE}+"), lambda t: t != "").alias("_w"),
    )
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / F.lit(float(stride)))).cast("int")
    at = cut.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last)))
    window = F.array_join(F.slice("_w", F.col("chunk_idx") * stride + 1, F.lit(size)), " ")
    return at.select(
        key, "chunk_idx", F.when(F.size("_w") <= size, F.col("_t")).otherwise(window).alias("text")
    )


def proportional_sample(chunks: DataFrame, key: str, cap: int = CHUNK_CAP) -> DataFrame:
    """At most ``cap`` evenly spread chunks per document: the positions ``int(i * n / cap)``.

    Whether a position is chosen is a closed form of the position and the document's
    chunk count, so the only extra work is that count.
    """
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return chunks.join(counts, key).where((F.col("_n") <= cap) | _sampled(cap)).drop("_n")


def sparse_fallback(chunks: DataFrame, texts: DataFrame, key: str, least: int = SPARSE_CHUNKS) -> DataFrame:
    """Replace the chunks of documents with fewer than ``least`` by a split of their raw text."""
    rich = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    return chunks.join(rich, key, "left_semi").unionByName(
        chunk_rows(texts.join(rich, key, "left_anti"), key, "raw_text")
    )


def document_chunks(texts: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Chunks of ``(<key>, text, raw_text)`` documents: the split of the labelled text.

    With ``least``, a document whose labelled text gives fewer chunks is split from its raw text
    instead. Counts are array sizes here, so nothing is shuffled. ``proportional_sample`` is a step
    of its own for callers that want fewer chunks."""
    split = make_splitter()
    chosen = split(F.coalesce("text", F.lit("")))
    rows = texts
    if least is not None:
        rows = texts.withColumn("_s", chosen)
        rows = rows.withColumn("_r", split(F.when(F.size("_s") < least, F.col("raw_text"))))
        chosen = F.when(F.size("_s") >= least, F.col("_s")).otherwise(F.col("_r"))
    return exploded(rows, [key], chosen, "chunk_idx", "text")


def _sampled(cap: int) -> Column:
    """Whether ``chunk_idx`` is ``int(i * _n / cap)`` for some ``i`` below ``cap``."""
    step = F.col("_n").cast("double") / F.lit(float(cap))
    near = F.floor(F.col("chunk_idx") / step)
    return F.exists(
        F.array(near, near + 1),
        lambda i: (i < cap) & (F.floor(i.cast("double") * step) == F.col("chunk_idx")),
    )


def filing_metadata(text: Column) -> list[Column]:
    return [filing_type(text).alias("filing_type"), filing_period(text).alias("period")]


def with_prefixes(chunks: DataFrame, prefixes: DataFrame, key: str) -> DataFrame:
    """Chunks with the context written for them; a missing context is empty."""
    joined = chunks.join(prefixes.select(key, "chunk_idx", "prefix"), [key, "chunk_idx"], "left")
    prefix = trim_space(F.coalesce("prefix", F.lit("")))
    return joined.select(
        *[c for c in chunks.columns if c != "text"],
        prefix.alias("prefix"),
        F.when(prefix != "", F.concat_ws("\n", prefix, "text")).otherwise(F.col("text")).alias("text"),
    )


def batch_prefixes(replies: DataFrame, key: str) -> DataFrame:
    """One row per chunk from replies that cover ``batch_size`` chunks from ``first_idx`` on.
    Short replies are padded with empty prefixes, long ones cut."""
    at = replies.select(
        key, "first_idx", "contexts", F.explode(F.sequence(F.lit(0), F.col("batch_size") - 1)).alias("_i")
    )
    return at.select(
        key,
        (F.col("first_idx") + F.col("_i")).cast("int").alias("chunk_idx"),
        F.coalesce(F.get("contexts", F.col("_i")), F.lit("")).alias("prefix"),
    )


def publishable(chunks: DataFrame, key: str, share: float = PREFIX_SHARE) -> DataFrame:
    """Per document whether enough chunks carry a prefix for the index to be kept."""
    return (
        chunks.groupBy(key)
        .agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("prefix") != "").alias("prefixed"))
        .withColumn("publish", F.col("prefixed") >= F.col("chunks") * share)
    )


def gated(chunks: DataFrame, publish: DataFrame, key: str, cap: int = CHUNK_CAP) -> DataFrame:
    """Chunks with ``sampled``, whether ``proportional_sample`` keeps them, and the ``publish`` flag of
    their document, from the counts of ``publishable``."""
    counts = publish.select(key, F.col("chunks").alias("_n"), "publish")
    sampled = ((F.col("_n") <= cap) | _sampled(cap)).alias("sampled")
    return chunks.join(counts, key).select(*chunks.columns, sampled, "publish")


def postings(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Term counts per chunk, with the chunk's length in terms."""
    cut = chunks.select(*keys, tokens(F.col("text")).alias("_t"))
    return (
        exploded(cut, [*keys, F.size("_t").alias("len")], F.col("_t"), "_i", "term")
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    )


def term_stats(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Chunks per term. Terms are made distinct inside their chunk before the shuffle."""
    return (
        exploded(chunks, scope, F.array_distinct(tokens(F.col("text"))), "_i", "term")
        .groupBy(*scope, "term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def corpus_stats(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    return (
        chunks.select(*scope, F.size(tokens(F.col("text"))).alias("_len"))
        .groupBy(*scope)
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("_len").alias("avg_len"))
    )

"""Hybrid retrieval for a table of queries.

A query sees the chunks of its scope, usually one document, and chunk ids need be unique within
a scope only. The lexical channel joins query terms with postings and adds chunks without any term
from their ids alone; the verbatim channel looks terms up among the tokens of the same postings. Both
run in the JVM. Of blocks of postings the most that they can add to a score is known. The dense channel deals vectors and queries to a grid of blocks and multiplies them.

Scores are rounded to 9 decimals before ranking, so copies of a chunk tie exactly; ties go
to the larger chunk id in the scored channels and to the smaller one in the verbatim
channel.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.text import SPACE, exact_terms, tokens
from rubricon.operators.containment import contained, let
from rubricon.operators.grouping import LOOKUP_ROWS, exploded, lookups, maybe_in, numbered, top_k
from rubricon.operators.index import corpus_stats, postings
from rubricon.session import scratch, stored

# Channel depth, fused and reranked depth, fusion constant, ranking weights.
CHANNEL_K, FUSED_K, RERANK_K, RRF_BASE = 40, 80, 20, 60
BM25_K1, BM25_B, BM25_FLOOR = 1.5, 0.75, 0.25
# Texts between joined chunks and between passages.
JOIN_MARK = "\n[Contiguous Block Extension]\n"
BREAK_MARK = "\n\n[... Structural Fragment Break ...]\n\n"

HITS = "query_id long, chunk_id long, score double"
# Chunk ids of a posting block; up to how many chunks a term is read whole for the first threshold, and
# how many of its best blocks beyond; what rounding of sums may take away from a bound.
BLOCK_IDS, RARE_CHUNKS, HEAD_BLOCKS, SLACK = 1_024, 16_384, 4, 1e-6
# Rows of a block of the dense channel's grid, and of one product inside it.
BLOCK_VECTORS, BLOCK_QUERIES, PRODUCT_ROWS = 65_536, 512, 4_096


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["query_id"], [F.desc("score"), F.desc("chunk_id")], k, "rank")


def query_weights(queries: DataFrame, scope: str, terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """Weight of every query term that occurs in the query's corpus.

    ``terms(<scope>, term, df, ...)`` and ``corpus(<scope>, n_chunks, avg_len)`` are tables of an index;
    further columns of the terms are kept. The weight is the term's inverse document frequency times
    its repetitions in the query; a negative frequency weight is replaced by a quarter of the corpus mean.
    """
    idf = (
        terms.join(queries.select(scope).distinct(), scope, "left_semi")
        .join(corpus.select(scope, "n_chunks"), scope)
        .withColumn("idf", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        .drop("n_chunks")
    )
    mean = idf.groupBy(scope).agg(F.avg("idf").alias("mean_idf"))
    asked = (
        exploded(queries, [scope, "query_id"], tokens(F.col("text")), "_i", "term")
        .groupBy(scope, "query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    floor = F.lit(BM25_FLOOR) * F.col("mean_idf")
    weight = F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")) * F.col("qtf")
    return asked.join(idf, [scope, "term"]).join(mean, scope).withColumn("weight", weight).drop("qtf", "idf", "mean_idf")


def impacts(rows: DataFrame, corpus: DataFrame, scope: str) -> DataFrame:
    """Postings ``<scope>, term, chunk_id, block, impact``: what a term adds to a chunk's score per unit of
    weight, and the block of ``BLOCK_IDS`` neighbouring ids that the chunk belongs to."""
    tf, length = F.col("tf"), F.col("len") / F.col("avg_len")
    impact = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length))
    block = F.floor(F.col("chunk_id") / BLOCK_IDS).cast("long")
    return rows.join(corpus.select(scope, "avg_len"), scope).select(scope, "term", "chunk_id", block.alias("block"), impact.alias("impact"))


def lexical_tables(chunks: DataFrame, scope: str, rows: DataFrame | None = None, corpus: DataFrame | None = None) -> dict[str, DataFrame]:
    """``postings`` with impacts, stored, the best impact per term and block, ``terms`` and ``corpus``.
    ``rows`` and ``corpus`` are the counts of an index, where they are there already."""
    # Small tables are stored, as Spark broadcasts only what it knows to be small.
    corpus = stored(corpus_stats(chunks, [scope]) if corpus is None else corpus, "corpus")
    rows = _counts(chunks, [scope, "chunk_id"]) if rows is None else rows
    held = stored(impacts(rows, corpus, scope), "postings")
    best = F.max("impact")
    return {
        "postings": held,
        "blocks": held.groupBy(scope, "term", "block").agg(best.alias("best")),
        "terms": stored(held.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"), best.alias("reach")), "vocabulary"),
        "corpus": corpus,
    }


def _counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``postings``, where the terms of a chunk are counted inside its row, so that they stay where the
    text is read; only chunks that share their keys with others are brought together."""
    again = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    again = stored(again, "repeated-chunks")
    held = chunks.select(*keys, "text")
    same = lambda: reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    once = held if again.isEmpty() else held.join(again, same(), "left_anti")

    def runs(words: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        count = lambda at, i: F.coalesce(F.get(at, i + 1), F.size(words)) - F.get(at, i)
        return let(first, lambda at: F.transform(at, lambda s, i: F.struct(F.get(words, s).alias("term"), count(at, i).cast("long").alias("tf"), F.size(words).alias("len"))))

    words = F.array_sort(tokens(F.col("text")))
    counted = exploded(once, keys, let(words, lambda w: F.when(F.size(w) > 0, runs(w))), "_i", "_r")
    rows = counted.select(*keys, "_r.term", "_r.tf", "_r.len")
    return rows if once is held else rows.unionByName(postings(held.join(again, same(), "left_semi"), keys))


def lexical_channel(
    chunks: DataFrame, queries: DataFrame, scope: str, k: int = CHANNEL_K, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Best ``k`` chunks per query by BM25, chunks without any query term included.

    ``chunks(<scope>, chunk_id, text)``, ``queries(<scope>, query_id, text)``; a query sees the chunks
    of its scope only. ``tables`` are those of ``lexical_tables``; with them the
    texts are not read. A query without any known term still ranks its corpus, with zero scores.

    Common words are read only where they can matter. A first pass over rare terms and the best blocks
    of common ones gives every query a threshold, the k-th best score so far. Terms that cannot reach it
    together are left for last: they are looked up for those chunks only that the others bring near it.
    Blocks of the others are skipped where all other terms at their best would not lift them to it.
    A query with fewer than ``k`` chunks so far, or with a negative weight, has no threshold and reads all.
    Where queries have few terms, these go to the postings, which then stay where they are.
    """
    tables = tables or lexical_tables(chunks, scope)
    with scratch(chunks.sparkSession) as put:
        matched = stored(_matches(queries, scope, k, tables, put), "matches")
    return _ranked(matched.select("query_id", "chunk_id", "score").unionByName(_unmatched(chunks, queries, scope, matched, k)), k)


def _matches(queries: DataFrame, scope: str, k: int, tables: dict[str, DataFrame], put) -> DataFrame:
    """<scope>, query_id, chunk_id, score: chunks with a term of the query, all that can be among the best ``k``.
    ``put`` stores what is read here only."""
    held = tables["postings"]
    weights = stored(query_weights(queries, scope, tables["terms"], tables["corpus"]).withColumn("most", F.col("weight") * F.col("reach")), "weights")
    brief = lookups(weights)
    # Blocks matter for common terms only.
    common = brief(weights.where(F.col("df") > RARE_CHUNKS).select(scope, "term").distinct())
    blocks = stored(tables["blocks"].join(common, [scope, "term"], "left_semi"), "blocks")
    # Of the postings those of common terms are all that is moved, not all that the joins below would meet.
    often = held.join(common, [scope, "term"], "left_semi")
    cut = _thresholds(held, often, blocks, weights, scope, k, brief)
    plan = stored(_last_terms(weights, cut, scope), "terms")
    least = F.col("cut") - SLACK
    rare = F.col("df") <= RARE_CHUNKS
    open_ = F.col("weight") * F.col("best") + F.col("total") - F.col("most") >= least
    seen = blocks.join(brief(plan.where(~rare & ~F.col("last"))), [scope, "term"]).where(open_)
    seen = stored(seen.select(scope, "term", "block", "query_id", "weight"), "open-blocks")
    parts = _parts(held, brief(plan.where(rare)), scope).unionByName(_parts(often, lookups(seen)(seen), scope))
    partial_ = put(parts.groupBy(scope, "query_id", "chunk_id").agg(F.sum("part").alias("part")), "partial")
    # What is known by now of chunks is a better threshold.
    last = brief(plan.where("last").select(scope, "query_id", "term", "weight", "most"))
    limits = brief(last.groupBy("query_id").agg(F.sum("most").alias("rest")))
    reached = _kth_best(partial_.join(limits.select("query_id"), "query_id", "left_semi").withColumnRenamed("part", "score"), k)
    limits = brief(put(limits.join(reached, "query_id", "left"), "limits"))
    close = F.col("cut").isNull() | (F.col("part") + F.col("rest") >= least)
    near = put(partial_.join(limits, "query_id", "left").where(close).drop("cut", "rest"), "near")
    block = F.floor(F.col("chunk_id") / BLOCK_IDS).cast("long").alias("block")
    touched = near.select(scope, "query_id", block).distinct().join(last, [scope, "query_id"]).select(scope, "term", "block").distinct()
    touched = put(touched, "touched-blocks")
    # Many blocks would move the postings as the lookup itself does.
    looked = often.join(F.broadcast(touched), [scope, "term", "block"], "left_semi") if touched.count() <= LOOKUP_ROWS else often
    pairs, last = near.select(scope, "query_id", "chunk_id"), last.drop("most")
    if brief is F.broadcast:
        # Chunks meet their common words, of which the query's own are kept on the spot.
        added = pairs.join(looked, [scope, "chunk_id"]).join(last, [scope, "query_id", "term"])
    else:
        added = looked.join(pairs.join(last, [scope, "query_id"]), [scope, "term", "chunk_id"])
    matched = near.unionByName(added.select(scope, "query_id", "chunk_id", (F.col("weight") * F.col("impact")).alias("part")))
    return matched.groupBy(scope, "query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"))


def _parts(held: DataFrame, terms: DataFrame, scope: str) -> DataFrame:
    """What each term adds to each chunk, in its blocks only where they are given."""
    on = [scope, "term", "block"] if "block" in terms.columns else [scope, "term"]
    joined = held.join(terms.select(*on, "query_id", "weight"), on)
    return joined.select(scope, "query_id", "chunk_id", (F.col("weight") * F.col("impact")).alias("part"))


def _thresholds(held: DataFrame, often: DataFrame, blocks: DataFrame, weights: DataFrame, scope: str, k: int, brief) -> DataFrame:
    """query_id, cut: a score that ``k`` chunks of the query reach, for queries with common terms."""
    sure = weights.groupBy("query_id").agg(F.min("weight").alias("_w"), F.max("df").alias("_df"))
    sure = sure.where((F.col("_w") >= 0) & (F.col("_df") > RARE_CHUNKS)).select("query_id")
    weights = weights.join(brief(sure), "query_id", "left_semi").select(scope, "query_id", "term", "weight", "df")
    rare, common = weights.where(F.col("df") <= RARE_CHUNKS), weights.where(F.col("df") > RARE_CHUNKS)
    heads = top_k(blocks, [scope, "term"], [F.desc("best"), F.asc("block")], HEAD_BLOCKS, "_i").select(scope, "term", "block")
    seen = _parts(held, brief(rare), scope).unionByName(_parts(often, brief(brief(common).join(heads, [scope, "term"])), scope))
    return _kth_best(seen.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), k)


def _kth_best(sums: DataFrame, k: int) -> DataFrame:
    """query_id, cut: the k-th best score of the queries that have so many."""
    best = top_k(sums.select("query_id", "score"), ["query_id"], [F.desc("score")], k, "_i")
    return best.groupBy("query_id").agg(F.min("score").alias("cut"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")


def _last_terms(weights: DataFrame, cut: DataFrame, scope: str) -> DataFrame:
    """Terms with the query's ``cut`` (below all scores where there is none), the ``total`` of what its
    terms can add, and whether a term is among the ``last``, common ones which cannot reach the cut
    together. Rare terms are read whole, which costs less than looking them up."""
    w = weights.join(cut, "query_id", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))
    of_query = Window.partitionBy("query_id")
    common = F.col("df") > RARE_CHUNKS
    upto = F.sum("most").over(of_query.orderBy(~common, "most", "term").rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumns({"total": F.sum("most").over(of_query), "last": common & (upto < F.col("cut") - SLACK)})
    return w.select(scope, "query_id", "term", "weight", "df", "most", "cut", "total", "last")


def _unmatched(chunks: DataFrame, queries: DataFrame, scope: str, matched: DataFrame, k: int) -> DataFrame:
    """Chunks without a term, the largest ids first, for queries with fewer than ``k`` positive scores.

    Such a query finds what it needs among the ``k`` plus as many last ids of its scope as it has
    matches, which are fewer than ``k`` unless scores are negative.
    """
    counts = matched.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("_up"), F.count(F.lit(1)).alias("_m"))
    short = queries.select(scope, "query_id").distinct().join(counts, "query_id", "left").fillna(0, ["_up", "_m"]).where(F.col("_up") < k)
    most = short.agg(F.max("_m")).first()[0]
    last = top_k(chunks.select(scope, "chunk_id"), [scope], [F.desc("chunk_id")], k + (most or 0), "_i")
    free = short.join(last, scope).where(F.col("_i") < k + F.col("_m"))
    free = free.join(matched.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return free.select("query_id", "chunk_id", F.lit(0.0).alias("score"))


def dense_channel(vectors: DataFrame, queries: DataFrame, k: int = CHANNEL_K, scope: str | None = None) -> DataFrame:
    """Best ``k`` chunks per query by plain dot product.

    ``vectors([<scope>,] chunk_id, vector)``, ``queries([<scope>,] query_id, vector)``; with ``scope``
    a query sees the vectors of its scope only. The vectors of a scope are dealt to row blocks and its
    queries to column blocks, as many as keep a block within ``BLOCK_VECTORS`` and ``BLOCK_QUERIES``;
    a task forms the products of one pair of blocks and keeps the best of each query. A missing number
    of a vector adds nothing; where the vector or that of the query is missing, the chunk has no score and comes
    last, and where both are, it is left out.
    """
    of_scope = (F.col(scope) if scope else F.lit("")).alias("scope")
    v = vectors.select(of_scope, "chunk_id", "vector")
    q = queries.select(of_scope, "query_id", "vector")
    blocks = lambda df, size: df.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    grid = blocks(v, BLOCK_VECTORS).withColumnRenamed("n", "rows").join(blocks(q, BLOCK_QUERIES).withColumnRenamed("n", "columns"), "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    none = F.lit(None).cast("long")
    mine = v.join(grid, "scope").withColumn("row", dealt("chunk_id", "rows")).withColumn("column", every("columns"))
    asked = q.join(grid, "scope").withColumn("column", dealt("query_id", "columns")).withColumn("row", every("rows"))
    narrow = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    vector = F.col("vector").cast("array<float>" if narrow else "array<double>").alias("vector")
    kind = lambda vector_: F.lit(vector_).alias("is_vector")
    sides = asked.select("scope", "row", "column", "query_id", none.alias("chunk_id"), vector, kind(False)).unionByName(
        mine.select("scope", "row", "column", none.alias("query_id"), "chunk_id", vector, kind(True))
    )
    cells = sides.repartition("scope", "row", "column").sortWithinPartitions("scope", "row", "column", "is_vector", F.desc("chunk_id"))
    return _ranked(cells.mapInArrow(partial(_products, k=k), HITS), k)


def _products(batches, k):
    """Best rows of each query over cells whose queries come before their vectors, larger ids first."""
    cell, queries, held = None, [], None
    for batch in batches:
        scopes, rows, columns = (batch.column(i) for i in range(3))
        keys = list(zip(scopes.to_pylist(), rows.to_pylist(), columns.to_pylist()))
        edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for first, last in zip(edges, edges[1:]):
            part = batch.slice(first, last - first)
            if keys[first] != cell:
                if held is not None:
                    yield held.hits()
                cell, queries, held = keys[first], [], None
            n = part.num_rows - part.column(6).true_count
            if n:
                queries.append(part.slice(0, n))
            if n < part.num_rows and queries:
                held = held or _Block(queries, k)
                held.offer(part.slice(n))
    if held is not None:
        yield held.hits()


class _Block:
    """The best ``k`` vectors of each query of a block, larger id first on equal scores."""

    def __init__(self, queries, k):
        self.ids = pa.concat_arrays([b.column(3) for b in queries])  # one of them may be null
        self.missing = np.concatenate([_missing(b) for b in queries])
        rows = [_rows(b) for b in queries]
        self.matrix = np.concatenate([_widened(r, max(x.shape[1] for x in rows)) for r in rows])
        self.norms = np.linalg.norm(self.matrix, axis=1)
        self.k = k
        self.place, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.floor = np.full(len(self.ids), -np.inf)

    def offer(self, batch):
        ids, rows, missing = batch.column(4).to_numpy(), _rows(batch), _missing(batch)
        for at in range(0, len(ids), PRODUCT_ROWS):
            mine = _widened(rows[at : at + PRODUCT_ROWS], self.matrix.shape[1])
            # No product is larger than the product of the norms.
            reach = self.norms * np.linalg.norm(mine, axis=1).max(initial=0.0) * (1 + 1e-9) + 1e-9
            open_ = np.flatnonzero(reach >= self.floor)
            if len(open_):
                without, asked = missing[at : at + PRODUCT_ROWS, None], self.missing[None, open_]
                scores = np.where(without | asked, -np.inf, np.round(mine @ self.matrix[open_].T, 9))
                self._keep(open_, np.where(without & asked, np.nan, scores), ids[at : at + PRODUCT_ROWS])

    def _keep(self, queries, scores, ids):
        known = ~np.isnan(scores)
        scores = np.where(known, scores, -np.inf)
        floor = self.floor[queries]
        if len(ids) > self.k:
            cut = len(ids) - self.k
            floor = np.maximum(floor, np.partition(scores, cut, axis=0)[cut])
        row, column = np.nonzero((scores >= floor) & known)
        place = np.concatenate([self.place, queries[column]])
        score = np.concatenate([self.score, scores[row, column]])
        found = np.concatenate([self.found, ids[row]])
        order = np.lexsort((-found, -score, place))
        place, score, found = place[order], score[order], found[order]
        kept = np.arange(len(place)) - np.searchsorted(place, place) < self.k
        self.place, self.score, self.found = place[kept], score[kept], found[kept]
        full = np.flatnonzero(np.bincount(self.place, minlength=len(self.ids)) == self.k)
        self.floor[full] = self.score[np.searchsorted(self.place, full, "right") - 1]

    def hits(self):
        columns = [self.ids.take(pa.array(self.place)), pa.array(self.found), pa.array(self.score, mask=np.isneginf(self.score))]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])


def _rows(batch):
    """The vectors of a batch, filled up with zeros to the longest of them."""
    vectors = batch.column(5)
    flat, sizes = vectors.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64), vectors.value_lengths().fill_null(0).to_numpy()
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(batch.num_rows, width)
    rows = np.zeros((batch.num_rows, width))
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows


def _missing(batch):
    return batch.column(5).value_lengths().fill_null(0).to_numpy() == 0


def _widened(rows, width):
    """Rows of ``width`` columns; numbers beyond those of the queries have no partner."""
    return rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def dense_scores(vectors: DataFrame, query: str = "query_vector") -> DataFrame:
    """Dot product of two vector columns of one row, inside the JVM."""
    product = F.aggregate(
        F.zip_with("vector", query, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return vectors.withColumn("score", product)


def verbatim_hits(chunks: DataFrame, queries: DataFrame, scope: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """How many of a query's exact terms each chunk of its scope holds, as substrings.

    A term without white space lies inside one token of the text, so it is looked up among the distinct
    tokens, by gram, and these in the postings; texts are not read. A phrase is looked up by its longest
    word, and only the chunks that hold this are searched for it. A term that is nothing but white space
    is looked up among the white space of the texts. ``tables`` are those of ``lexical_tables``.
    """
    asked = exploded(queries, [scope, "query_id"], exact_terms(F.col("text")), "_i", "term")
    # A term listed twice by a query (case variants) counts twice.
    asked = asked.groupBy(scope, "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    pieces = F.filter(F.split("term", SPACE + "+"), lambda w: w != "")
    longest = F.aggregate(pieces, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    asked = stored(asked.withColumns({"needle": longest, "single": ~F.col("term").rlike(SPACE)}), "exact-terms")
    scopes = asked.select(scope).distinct()
    tables = tables or lexical_tables(chunks, scope)
    tokens_ = tables["terms"].join(scopes, scope, "left_semi").select(scope, F.col("term").alias("haystack"))
    spaced = asked.where("needle = ''")
    gaps = chunks.join(spaced.select(scope).distinct(), scope, "left_semi")
    gaps = exploded(gaps, [scope, "chunk_id"], F.regexp_extract_all(F.lower("text"), F.lit(f"{SPACE}+"), F.lit(0)), "_i", "term").drop("_i")

    def within(needles: DataFrame, texts: DataFrame, holders: DataFrame) -> DataFrame:
        inside = contained(needles.select("needle").distinct(), texts.select("haystack").distinct()).withColumnRenamed("haystack", "term")
        inside = stored(inside, "holding-terms")
        rows = holders.select(scope, "term", "chunk_id")
        # As many tokens as may hold a short term, the postings without any should stay where they are.
        return maybe_in(rows, "term", inside).join(inside, "term").select(scope, "needle", "chunk_id").distinct()

    words = asked.where("needle <> ''")
    found = words.join(within(words, tokens_, tables["postings"]), [scope, "needle"])
    kinds = {r[0] for r in asked.select(F.when(F.col("needle") == "", "blank").when(~F.col("single"), "phrase")).distinct().collect()}
    hit = ["query_id", "chunk_id", "term", "times"]
    hits = found.where("single").select(*hit)
    if "phrase" in kinds:
        found = stored(found, "found-words")  # read twice
        hits = found.where("single").select(*hit)
        texts = chunks.join(words.where("not single").select(scope).distinct(), scope, "left_semi")
        phrases = found.where("not single").join(texts.select(scope, "chunk_id", F.lower("text").alias("text")), [scope, "chunk_id"])
        hits = hits.unionByName(phrases.where(F.contains("text", "term")).select(*hit))
    if "blank" in kinds:
        blank = spaced.withColumn("needle", F.col("term"))
        blank = blank.join(within(blank, gaps.withColumnRenamed("term", "haystack"), gaps), [scope, "needle"])
        hits = hits.unionByName(blank.select(*hit))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum("times").alias("hits"))


def verbatim_channel(chunks: DataFrame, queries: DataFrame, scope: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """All hits with their 0-based rank: more terms first, then document order. Hits are stored
    because ranking reads them twice."""
    hits = stored(verbatim_hits(chunks, queries, scope, tables), "verbatim-hits")
    return numbered(hits, ["query_id"], ["hits"], "chunk_id", "rank")


def fuse(channels: list[DataFrame], k: int = FUSED_K) -> DataFrame:
    """Reciprocal-rank fusion of ``(query_id, chunk_id, rank)`` channels. Ties go to the
    earlier channel, then to the better rank in it."""
    rows = None
    for no, channel in enumerate(channels):
        part = channel.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.lit(no).alias("channel"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(RRF_BASE)) + F.col("rank"))), 12).alias("rrf"),
        F.min(F.struct("channel", "rank")).alias("_first"),
    )
    order = [F.desc("rrf"), F.asc("_first.channel"), F.asc("_first.rank")]
    return top_k(fused, ["query_id"], order, k, "fused_rank").drop("_first")


def rerank(candidates: DataFrame, scores: DataFrame, k: int = RERANK_K) -> DataFrame:
    """Best ``k`` candidates by supplied rerank score; ties keep the fused order."""
    joined = candidates.join(scores.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"])
    return top_k(joined, ["query_id"], [F.desc("rerank_score"), F.asc("fused_rank")], k, "rerank_rank")


def passages(top: DataFrame, document_order: bool = False) -> DataFrame:
    """Merge neighbouring top chunks into passages: ``query_id, passage_rank, chunk_idx``.

    ``top(query_id, chunk_idx, rerank_rank)`` holds the bounded top list of each query. In
    rank order a passage starts at every chunk that no earlier passage covered and runs
    on while the next chunk is in the list, even into a chunk already used.
    """
    order = "chunk_idx" if document_order else "rerank_rank"
    per_query = Window.partitionBy("query_id").orderBy("chunk_idx")
    island = top.withColumn("_isl", F.col("chunk_idx") - F.row_number().over(per_query))
    earlier = Window.partitionBy("query_id", "_isl").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.min("chunk_idx").over(earlier)
    starts = (
        island.withColumn("_seen", seen)
        .where(F.col("_seen").isNull() | (F.col("chunk_idx") < F.col("_seen")))
        .select("query_id", "_isl", F.col("chunk_idx").alias("_start"), F.col(order).alias("passage_rank"))
    )
    members = island.select("query_id", "_isl", "chunk_idx")
    return (
        starts.join(members, ["query_id", "_isl"])
        .where(F.col("chunk_idx") >= F.col("_start"))
        .select("query_id", "passage_rank", "chunk_idx")
    )


def context_text(passage_rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Context per query: chunks joined within, and passages joined across, by the marks."""
    with_text = passage_rows.join(chunks, keys)
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    one = with_text.groupBy("query_id", "passage_rank").agg(
        F.array_join(F.transform(ordered("chunk_idx", "text"), lambda s: s["text"]), JOIN_MARK).alias("passage")
    )
    return one.groupBy("query_id").agg(
        F.array_join(F.transform(ordered("passage_rank", "passage"), lambda s: s["passage"]), BREAK_MARK).alias("context")
    )

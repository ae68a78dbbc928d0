"""Queries over retrieval channels, fusion, passages, prompts and stored documents."""

from pyspark.sql import functions as F

from rubricon.catalog.base import SPACE_SQL, query, with_
from rubricon.functions.text import exact_terms
from rubricon.operators import documents, retrieval
from rubricon.plans.retrieve import retrieve
from rubricon.session import stored

_TOK = f"list_filter(string_split_regex(lower(text), '{SPACE_SQL}+'), lambda t: t <> '')"


def _bm25(corpus: str, queries: str) -> str:
    """BM25 of ``queries(scope, query_id, text)`` over ``corpus(scope, chunk_id, text)``."""
    return f"""corpus AS ({corpus}), queries AS ({queries}),
tok AS (SELECT scope, chunk_id, unnest({_TOK}) AS term FROM corpus),
tf AS (SELECT scope, chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
len AS (SELECT scope, chunk_id, len({_TOK}) AS dl FROM corpus),
size AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY 1),
idf AS (SELECT scope, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN size USING (scope) GROUP BY scope, term, n),
mean AS (SELECT scope, avg(idf) AS m FROM idf GROUP BY 1),
q AS (SELECT scope, query_id, term, count(*) AS qtf FROM (SELECT scope, query_id, unnest({_TOK}) AS term FROM queries) GROUP BY 1, 2, 3),
w AS (SELECT q.scope, query_id, q.term, qtf * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS w FROM q JOIN idf ON idf.scope = q.scope AND idf.term = q.term JOIN mean ON mean.scope = q.scope),
part AS (SELECT query_id, tf.chunk_id, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM w JOIN tf ON tf.scope = w.scope AND tf.term = w.term
  JOIN len ON len.scope = tf.scope AND len.chunk_id = tf.chunk_id JOIN size ON size.scope = tf.scope GROUP BY 1, 2),
lexical AS (SELECT query_id, chunk_id, round(coalesce(s, 0.0), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0.0), 9) DESC, chunk_id DESC) - 1 AS INT) AS rank
  FROM queries q JOIN corpus c ON c.scope = q.scope LEFT JOIN part p USING (query_id, chunk_id) QUALIFY rank < 40)"""


_ALL_DOCS = "SELECT 'all' AS scope, doc_id AS chunk_id, text FROM documents"
_ALL_ITEMS = "SELECT 'all' AS scope, item_id AS query_id, text FROM benchmark"
_BY_SOURCE = "SELECT source AS scope, doc_id AS chunk_id, text FROM documents"
_SOURCE_ITEMS = "SELECT 'src' || (item_id % 25) AS scope, item_id AS query_id, text FROM benchmark"


def _docs(t, scope="all"):
    s = F.lit("all") if scope == "all" else F.col("source")
    return t.documents.select(s.alias("scope"), F.col("doc_id").alias("chunk_id"), "text")


def _items(t, scope="all"):
    s = F.lit("all") if scope == "all" else F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string"))
    return t.benchmark.select(s.alias("scope"), F.col("item_id").alias("query_id"), "text")


def _shown(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("lexical_channel", with_(_bm25(_ALL_DOCS, _ALL_ITEMS)) + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexical")
def _(t):
    """Every benchmark text against every document."""
    return _shown(retrieval.lexical_channel(_docs(t), _items(t), "scope"))


@query(
    "lexical_channel_by_source",
    with_(_bm25(_BY_SOURCE, _SOURCE_ITEMS)) + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexical",
)
def _(t):
    """Each source is its own corpus with its own statistics."""
    return _shown(retrieval.lexical_channel(_docs(t, "source"), _items(t, "source"), "scope"))


_DENSE = """centres AS (SELECT label AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
products AS (SELECT query_id, vec_id AS chunk_id, sum(CAST(embedding[i] AS DOUBLE) * v) AS s FROM embeddings JOIN centres ON true GROUP BY 1, 2)"""


def _centres(t):
    """Mean vector per label."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vector")
    )


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query(
    "dense_channel",
    with_(_DENSE)
    + """SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id DESC) - 1 AS INT) AS rank
  FROM products QUALIFY rank < 40""",
)
def _(t):
    """All vectors against the mean vector of every label."""
    return _shown(retrieval.dense_channel(_vectors(t), _centres(t)))


@query(
    "dense_scores",
    """WITH pairs AS (SELECT vec_id AS chunk_id, unnest(embedding) AS a FROM embeddings)
  SELECT chunk_id, round(sum(CAST(a AS DOUBLE) * a), 6) AS score FROM pairs GROUP BY 1""",
)
def _(t):
    """Row-wise dot product inside the JVM: every vector with itself."""
    rows = _vectors(t).withColumn("query_vector", F.col("vector"))
    return retrieval.dense_scores(rows).select("chunk_id", F.round("score", 6).alias("score"))


_STOP = "['The','What','When','Where','How','Did','Does','Was','Were','Has','Have','Which','Who','Why','And','But','For','With','That','This','From']"


def _terms(source: str) -> str:
    word = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?"
    return rf"""exact AS (SELECT query_id, list_transform(list_filter(list_distinct(list_concat(regexp_extract_all(text, '"([^"]+)"', 1),
    list_filter(regexp_extract_all(text, '{word}'), lambda t: regexp_matches(t, '\p{{Nd}}') OR contains(t, '-')
      OR (length(t) > 3 AND NOT (t = lower(t) AND t <> upper(t)) AND NOT list_contains({_STOP}, t))))),
    lambda t: length(t) > 2), lambda t: lower(t)) AS terms FROM {source})"""


@query("exact_terms", with_(_terms("(SELECT doc_id AS query_id, text FROM documents)")) + "SELECT query_id, list_sort(terms) AS terms FROM exact")
def _(t):
    return t.documents.select(F.col("doc_id").alias("query_id"), F.array_sort(exact_terms(F.col("text"))).alias("terms"))


_HITS = """hits AS (SELECT query_id, doc_id AS chunk_id, count(*) AS hits FROM (SELECT query_id, unnest(terms) AS term FROM exact)
  JOIN documents ON contains(lower(text), term) GROUP BY 1, 2),
verbatim AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) - 1 AS rank FROM hits)"""


@query("verbatim_channel", with_(_terms("(SELECT item_id AS query_id, text FROM benchmark)"), _HITS) + "SELECT query_id, chunk_id, hits, rank FROM verbatim")
def _(t):
    return retrieval.verbatim_channel(_docs(t), _items(t), "scope")


_ITEM_VECTORS = """vq AS (SELECT item_id AS query_id, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
vd AS (SELECT doc_id AS chunk_id, embedding AS dv FROM documents JOIN embeddings ON vec_id = doc_id),
dots AS (SELECT query_id, chunk_id, sum(a * b) AS s FROM (SELECT query_id, chunk_id, unnest(qv)::DOUBLE AS a, unnest(dv)::DOUBLE AS b FROM vq JOIN vd ON true) GROUP BY 1, 2),
dense AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id DESC) - 1 AS INT) AS rank FROM dots QUALIFY rank < 40)"""

_FUSED = """ranks AS (SELECT query_id, chunk_id, rank, 0 AS ch FROM lexical UNION ALL SELECT query_id, chunk_id, rank, 1 FROM dense
  UNION ALL SELECT query_id, chunk_id, rank, 2 FROM verbatim),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(ch * 1000000000::BIGINT + rank) AS first FROM ranks GROUP BY 1, 2),
candidates AS (SELECT query_id, chunk_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) - 1 AS INT) AS fused_rank FROM fused QUALIFY fused_rank < 80)"""

_HYBRID = with_(_bm25(_ALL_DOCS, _ALL_ITEMS), _ITEM_VECTORS, _terms("queries"), _HITS, _FUSED)


def _doc_vectors(t):
    e = t.embeddings
    return t.documents.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _item_vectors(t):
    e = t.embeddings
    return t.benchmark.join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))


def _candidates(t):
    tables = retrieval.lexical_tables(_docs(t), "scope")
    return retrieval.fuse(
        [
            retrieval.lexical_channel(_docs(t), _items(t), "scope", tables=tables),
            retrieval.dense_channel(_doc_vectors(t), _item_vectors(t)),
            retrieval.verbatim_channel(_docs(t), _items(t), "scope", tables=tables),
        ]
    )


@query("fused_candidates", _HYBRID + "SELECT query_id, chunk_id, rrf, fused_rank FROM candidates")
def _(t):
    return _candidates(t)


_RERANKED = """, reranked AS (SELECT c.*, round(1000.0 / n_chars, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(1000.0 / n_chars, 6) DESC, fused_rank) - 1 AS INT) AS rerank_rank
  FROM candidates c JOIN documents ON doc_id = chunk_id QUALIFY rerank_rank < 20)"""


def _rerank_scores(t, candidates):
    """Stand-in for a scoring model: short documents first."""
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.round(F.lit(1000.0) / F.col("n_chars"), 6).alias("rerank_score"))
    return candidates.select("query_id", "chunk_id").join(d, "chunk_id")


@query("reranked_chunks", _HYBRID + _RERANKED + " SELECT query_id, chunk_id, rerank_score, rerank_rank FROM reranked")
def _(t):
    # Stored, as both the scores and the ranking read them.
    c = stored(_candidates(t), "candidates")
    return retrieval.rerank(c, _rerank_scores(t, c)).select("query_id", "chunk_id", "rerank_score", "rerank_rank")


# Top chunks for the passage queries: events of a user are its chunk positions.
_TOP = """top AS (SELECT user_id AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk_idx, min(event_id) AS first FROM events GROUP BY 1, 2),
ranked AS (SELECT query_id, chunk_idx, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS r FROM top QUALIFY r < 20)"""


def _top(t):
    k = F.get_json_object("props", "$.k").cast("long")
    first = t.events.groupBy(F.col("user_id").alias("query_id"), k.alias("chunk_idx")).agg(F.min("event_id").alias("first"))
    from rubricon.operators.grouping import top_k

    return top_k(first, ["query_id"], [F.asc("first")], 20, "rerank_rank")


def _passage_sql(order: str) -> str:
    return (
        with_(_TOP)
        + f""", isl AS (SELECT *, chunk_idx - row_number() OVER (PARTITION BY query_id ORDER BY chunk_idx) AS isl FROM ranked),
  st AS (SELECT a.query_id, a.isl, a.chunk_idx AS start, a.{order} AS passage_rank FROM isl a WHERE NOT EXISTS
    (SELECT 1 FROM isl b WHERE b.query_id = a.query_id AND b.isl = a.isl AND b.{order} < a.{order} AND b.chunk_idx <= a.chunk_idx))
  SELECT st.query_id, CAST(passage_rank AS BIGINT) AS passage_rank, m.chunk_idx FROM st JOIN isl m ON m.query_id = st.query_id AND m.isl = st.isl AND m.chunk_idx >= st.start"""
    )


@query("passages_in_rank_order", _passage_sql("r"))
def _(t):
    return retrieval.passages(_top(t)).withColumn("passage_rank", F.col("passage_rank").cast("long"))


@query("passages_in_document_order", _passage_sql("chunk_idx"))
def _(t):
    return retrieval.passages(_top(t), document_order=True)


_CONTEXT = """, isl AS (SELECT query_id, chunk_id AS chunk_idx, rerank_rank AS r, chunk_id - row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS isl FROM reranked),
  st AS (SELECT a.query_id, a.isl, a.chunk_idx AS start, a.r FROM isl a WHERE NOT EXISTS
    (SELECT 1 FROM isl b WHERE b.query_id = a.query_id AND b.isl = a.isl AND b.r < a.r AND b.chunk_idx <= a.chunk_idx)),
  ps AS (SELECT st.query_id, st.r, string_agg(text, chr(10) || '[Contiguous Block Extension]' || chr(10) ORDER BY m.chunk_idx) AS passage
    FROM st JOIN isl m ON m.query_id = st.query_id AND m.isl = st.isl AND m.chunk_idx >= st.start JOIN documents ON doc_id = m.chunk_idx GROUP BY 1, 2)
  SELECT query_id, count(*) AS passages, md5(string_agg(passage, chr(10) || chr(10) || '[... Structural Fragment Break ...]' || chr(10) || chr(10) ORDER BY r)) AS context_md5 FROM ps GROUP BY 1"""


@query("retrieved_contexts", _HYBRID + _RERANKED + _CONTEXT)
def _(t):
    """Context text per benchmark query after all channels, fusion, rerank and merging."""
    out = retrieve(
        _docs(t),
        _items(t),
        "scope",
        vectors=_doc_vectors(t).withColumn("scope", F.lit("all")),
        query_vectors=_item_vectors(t),
        rerank_scores=lambda c: _rerank_scores(t, c),
    )
    breaks = (F.length("context") - F.length(F.replace("context", F.lit(retrieval.BREAK_MARK)))) / len(retrieval.BREAK_MARK)
    return out.select("query_id", (breaks + 1).cast("long").alias("passages"), F.md5("context").alias("context_md5"))


# --- stored documents and prompts ------------------------------------------------------

_STORE = "store AS (SELECT replace(source, 'src', 'src_') AS key, arg_max(text, doc_id) AS text, count(*) > 1 AS overwritten FROM documents WHERE text <> '' GROUP BY 1)"


def _store(t):
    saves = t.documents.select(F.replace("source", F.lit("src"), F.lit("src_")).alias("key"), F.col("doc_id").alias("seq"), "text")
    return documents.keyed_store(saves, ["key"])


@query("keyed_documents", with_(_STORE) + "SELECT key, md5(text) AS text_md5, overwritten FROM store")
def _(t):
    return _store(t).select("key", F.md5("text").alias("text_md5"), "overwritten")


_PROMPTS = """prompts AS (SELECT conv_id * 1000 + turn AS prompt_id, CASE turn % 4 WHEN 0 THEN role || ': {{src_' || (conv_id % 23) || '}} and {{src__' || (turn % 21) || '}} please'
  WHEN 1 THEN 'Read {{src ' || (conv_id % 20) || '}}' WHEN 2 THEN 'no document' ELSE '{{src_' || (conv_id % 20) || '}}{{src_' || (conv_id % 20) || '}}' END AS prompt FROM conversations)"""


def _prompts(t):
    n = F.col("turn") % 4
    c = lambda m: (F.col("conv_id") % m).cast("string")
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"),
        F.when(n == 0, F.concat("role", F.lit(": {{src_"), c(23), F.lit("}} and {{src__"), (F.col("turn") % 21).cast("string"), F.lit("}} please")))
        .when(n == 1, F.concat(F.lit("Read {{src "), c(20), F.lit("}}")))
        .when(n == 2, "no document")
        .otherwise(F.concat(F.lit("{{src_"), c(20), F.lit("}}{{src_"), c(20), F.lit("}}")))
        .alias("prompt"),
    )


@query(
    "resolved_keys",
    with_(_STORE, _PROMPTS)
    + r""", refs AS (SELECT prompt_id, CAST(i AS INT) AS ref_pos, r[i + 1] AS ref FROM (SELECT prompt_id, regexp_extract_all(prompt, '\{\{([^{}]+)\}\}', 1) AS r FROM prompts),
    LATERAL (SELECT unnest(range(len(r))) AS i)),
  keyed AS (SELECT refs.*, coalesce(e.key, f.key) AS key FROM refs LEFT JOIN store e ON e.key = ref
    LEFT JOIN store f ON f.key = trim(regexp_replace(replace(ref, ' ', '_'), '_+', '_', 'g'), '_'))
  SELECT *, CASE WHEN key IS NULL THEN 'unknown key ' || ref END AS error FROM keyed
  UNION ALL SELECT prompt_id, 0, NULL, NULL, 'no key' FROM prompts WHERE NOT contains(prompt, '{{')""",
)
def _(t):
    return documents.resolve_keys(_prompts(t), _store(t))


@query(
    "filled_prompts",
    with_(_STORE, _PROMPTS)
    + r""", ranged AS (SELECT prompt_id, prompt, r FROM (SELECT prompt_id, prompt, regexp_extract_all(prompt, '\{\{([^{}]+)\}\}', 1) AS r FROM prompts)),
  t AS (SELECT prompt_id, prompt, r, a.text AS ta, b.text AS tb, a.key AS ka, b.key AS kb FROM ranged LEFT JOIN store a ON a.key = r[1] LEFT JOIN store b ON b.key = r[2])
  SELECT prompt_id, md5(CASE WHEN len(r) = 0 OR ka IS NULL OR (len(r) = 2 AND kb IS NULL) THEN NULL WHEN len(r) = 1 THEN replace(prompt, '{{' || r[1] || '}}', ta)
    WHEN r[1] = r[2] THEN ta[11:-6] || ta[11:-6]
    ELSE split_part(prompt, '{{', 1) || ta || ' and ' || tb || ' please' END) AS text_md5,
  CASE WHEN len(r) = 0 THEN 'no reference' WHEN ka IS NULL OR (len(r) = 2 AND kb IS NULL) THEN 'unknown key' END AS error FROM t""",
)
def _(t):
    """Prompts that name one document twice ask for characters 10 to 5 before the end."""
    p = _prompts(t)
    twice = p.where(F.col("prompt_id") % 1000 % 4 == 3).select(
        "prompt_id",
        F.regexp_extract("prompt", documents.KEY_PATTERN, 1).alias("key"),
        F.lit(10).alias("start"),
        F.lit(-5).alias("end"),
    )
    out = documents.fill_prompts(p, _store(t), twice)
    return out.select("prompt_id", F.md5("text").alias("text_md5"), "error")


@query(
    "context_or_text",
    with_(_STORE)
    + """SELECT c_custkey AS query_id, key, md5(CASE WHEN c_custkey % 2 = 0 THEN 'context ' || c_custkey ELSE text END) AS context_md5
  FROM (SELECT c_custkey, 'src_' || (c_custkey % 22) AS key FROM customer) LEFT JOIN store USING (key)""",
)
def _(t):
    """Customers ask; every second one has a retrieved context."""
    requests = t.customer.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("src_"), (F.col("c_custkey") % 22).cast("string")).alias("key"))
    found = t.customer.where(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("context "), F.col("c_custkey").cast("string")).alias("context")
    )
    out = documents.context_or_text(requests, found, _store(t))
    return out.select("query_id", "key", F.md5("context").alias("context_md5"))


@query("first_questions", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 3")
def _(t):
    return documents.first_by_position(t.benchmark, [F.asc("item_id")], 3)

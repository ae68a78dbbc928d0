"""Queries over pages, blocks, chunks and their statistics."""

from pyspark.sql import functions as F

from rubricon.catalog.base import LINES, SPACE_SQL, query, with_
from rubricon.functions import text as tx
from rubricon.functions.html import plain_page_text
from rubricon.functions.jsontext import (
    context_list,
    extracted_facts,
    find_json,
    json_field,
    json_kind,
)
from rubricon.operators import index
from rubricon.operators.grouping import spread
from rubricon.operators.replies import reply_or
from rubricon.plans.build_index import build_index

_L = with_(LINES)
_SECTION_SQL = tx.SECTION_PATTERN
_TRIM_SQL = rf"regexp_replace(text, '\A{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g')"
_HEADER_SQL = f"regexp_matches({_TRIM_SQL}, '{_SECTION_SQL}')"
_TOKENS_SQL = f"list_filter(string_split_regex(lower(text), '{SPACE_SQL}+'), lambda t: t <> '')"


@query("page_keys", "SELECT page_id, url, substr(md5(url), 1, 12) AS url_key FROM pages")
def _(t):
    return t.pages.select("page_id", "url", tx.url_key(F.col("url")).alias("url_key"))


@query(
    "unseen_pages",
    """WITH k AS (SELECT page_id, url, substr(md5(url), 1, 12) AS url_key FROM pages),
  done AS (SELECT DISTINCT url_key FROM k JOIN labels ON doc_id = page_id WHERE quality = 1)
  SELECT url_key, min(page_id) AS page_id FROM k WHERE url_key NOT IN (SELECT url_key FROM done) GROUP BY 1""",
)
def _(t):
    """Pages with a good label count as indexed already."""
    labelled = t.labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("page_id"))
    done = t.pages.join(labelled, "page_id", "left_semi").select(tx.url_key(F.col("url")).alias("url_key"))
    return index.unseen_pages(t.pages.select("page_id", "url"), done).select("url_key", "page_id")


@query("page_blocks")
def _(t):
    """Blocks of every page with their markdown or text."""
    return index.block_rows(index.page_text_and_blocks(t.pages), "page_id")


@query("page_plain_text")
def _(t):
    parsed = index.page_text_and_blocks(t.pages)
    return parsed.select("page_id", plain_page_text(F.col("raw_text")).alias("text"))


@query("page_sections")
def _(t):
    """Section-labelled text of every page."""
    return index.labelled_text(index.page_text_and_blocks(t.pages)).select("page_id", "text")


@query("long_blocks", _L + "SELECT * FROM lines WHERE length(text) >= 40")
def _(t):
    return index.long_enough(t.lines())


@query(
    "section_lines",
    _L + f"SELECT doc_id, block_idx, {_HEADER_SQL} AS is_section FROM lines",
)
def _(t):
    return t.lines().select("doc_id", "block_idx", tx.is_section_line(F.col("text")).alias("is_section"))


_SECTIONS = f"""marked AS (SELECT *, CASE WHEN {_HEADER_SQL} THEN upper(replace({_TRIM_SQL}, 'ß', 'ss')) END AS h FROM lines),
carried AS (SELECT doc_id, block_idx, text, h, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'PREAMBLE') AS section FROM marked)"""


@query("sectioned_blocks", with_(LINES, _SECTIONS) + "SELECT doc_id, block_idx, text, section FROM carried WHERE h IS NULL")
def _(t):
    return index.sectioned(t.lines(), "doc_id")


@query(
    "blocks_without_repeats",
    """WITH l AS (SELECT source, doc_id AS block_idx, text FROM documents),
  n AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY block_idx) AS rn FROM l)
  SELECT source, block_idx, md5(text) AS h FROM n WHERE length(text) <= 500 OR rn = 1""",
)
def _(t):
    """Documents of one source are the blocks; later copies of long ones go."""
    blocks = t.documents.select("source", F.col("doc_id").alias("block_idx"), "text")
    return index.without_repeats(blocks, "source").select("source", "block_idx", F.md5("text").alias("h"))


@query(
    "blocks_without_adjacent_repeats",
    """WITH l AS (SELECT doc_id, CAST(i AS INT) AS block_idx, parts[i + 1] AS text FROM
    (SELECT doc_id, string_split(text, ' ') AS parts FROM documents), LATERAL (SELECT unnest(range(len(parts))) AS i))
  SELECT doc_id, block_idx, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY block_idx) AS prev FROM l) WHERE prev IS NULL OR prev <> text""",
)
def _(t):
    """Words of a document as blocks; a word equal to the one before it goes."""
    blocks = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("block_idx", "text"))
    return index.without_adjacent_repeats(blocks, "doc_id")


_WINDOWS = f"""windows AS (SELECT doc_id, CAST(i AS INT) AS chunk_idx, CASE WHEN len(w) <= 500 THEN text
  ELSE array_to_string(w[CAST(i * 425 + 1 AS INT):CAST(i * 425 + 500 AS INT)], ' ') END AS text FROM
  (SELECT doc_id, text, list_filter(string_split_regex(text, '{SPACE_SQL}+'), lambda t: t <> '') AS w FROM documents),
  LATERAL (SELECT unnest(range(CAST(greatest(0, ceil((len(w) - 500) / 425.0)) AS BIGINT) + 1)) AS i))"""


@query("word_windows", with_(_WINDOWS) + "SELECT * FROM windows")
def _(t):
    return index.word_window_rows(t.documents, "doc_id")


@query("text_chunks")
def _(t):
    """Recursive split of whole documents into overlapping chunks."""
    return index.chunk_rows(t.documents, "doc_id")


@query(
    "proportional_sample",
    with_(LINES)
    + """, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1),
  pick AS (SELECT doc_id, CAST(floor(i * (n / 3.0::DOUBLE)) AS BIGINT) AS block_idx FROM n, LATERAL (SELECT unnest(range(3)) AS i) WHERE n > 3)
  SELECT l.doc_id, l.block_idx FROM lines l JOIN n USING (doc_id) WHERE n <= 3
  UNION ALL SELECT l.doc_id, l.block_idx FROM lines l JOIN pick p ON p.doc_id = l.doc_id AND p.block_idx = l.block_idx""",
)
def _(t):
    """At most three evenly spread lines per document."""
    lines = t.lines().withColumnRenamed("block_idx", "chunk_idx")
    return index.proportional_sample(lines, "doc_id", cap=3).select("doc_id", F.col("chunk_idx").alias("block_idx"))


@query("sparse_fallback")
def _(t):
    """Documents with few word windows are split from their raw text instead."""
    windows = index.word_window_rows(t.documents, "doc_id", size=100, overlap=10)
    texts = t.documents.select("doc_id", F.col("text").alias("raw_text"))
    return index.sparse_fallback(windows, texts, "doc_id", least=4)


_META = """meta AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'FORM  10-K ' WHEN 1 THEN 'form 10-Q ' WHEN 2 THEN 'Form 8-K' WHEN 3 THEN 'FORM S-1' ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN ' For the fiscal year ended December 31, 2024 ' WHEN doc_id % 3 = 1 THEN ' for the  quarterly period ended March 3, 2025' ELSE '' END || text AS text FROM documents)"""


@query(
    "filing_metadata",
    with_(_META)
    + r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)FORM\s+10-K') THEN 'Form 10-K (Annual Report)' WHEN regexp_matches(text, '(?i)FORM\s+10-Q') THEN 'Form 10-Q (Quarterly Report)'
  WHEN regexp_matches(text, '(?i)FORM\s+8-K') THEN 'Form 8-K (Current Disclosure)' WHEN regexp_matches(text, '(?i)FORM\s+S-1') THEN 'Form S-1 (Registration Statement)' ELSE 'SEC Filing' END AS filing_type,
  coalesce(nullif(regexp_extract(text, '(?i)For\s+the\s+(?:fiscal\s+year|quarterly\s+period)\s+ended\s+([A-Za-z]+\s+\d{1,2},\s+\d{4})', 1), ''), 'Unknown Period') AS period FROM meta""",
)
def _(t):
    n, m = F.col("doc_id") % 5, F.col("doc_id") % 3
    head = F.when(n == 0, "FORM  10-K ").when(n == 1, "form 10-Q ").when(n == 2, "Form 8-K").when(n == 3, "FORM S-1").otherwise("")
    ended = (
        F.when(m == 0, " For the fiscal year ended December 31, 2024 ")
        .when(m == 1, " for the  quarterly period ended March 3, 2025")
        .otherwise("")
    )
    rows = t.documents.select("doc_id", F.concat(head, ended, "text").alias("text"))
    return rows.select("doc_id", *index.filing_metadata(F.col("text")))


@query(
    "document_samples",
    """SELECT doc_id, md5(CASE WHEN length(text) <= 12000 THEN text ELSE left(text, 4000) || chr(10) || chr(10) || '[... Middle Section ...]' || chr(10) || chr(10)
  || substr(text, greatest(0, length(text) // 2 - 2000) + 1, 4000) || chr(10) || chr(10) || '[... Tail Section ...]' || chr(10) || chr(10) || right(text, 4000) END) AS sample_md5 FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(tx.document_sample(F.col("text"))).alias("sample_md5"))


@query(
    "summaries_or_heads",
    """SELECT doc_id, md5(CASE WHEN quality = 1 THEN 'summary of ' || doc_id ELSE left(text, 2000) END) AS summary_md5
  FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    """Documents with a good label have a summary reply; the others use their first 2000 characters."""
    told = t.labels.where(F.col("quality") == 1).select(
        "doc_id", F.concat(F.lit("summary of "), F.col("doc_id").cast("string")).alias("content")
    )
    rows = reply_or(t.documents.select("doc_id", "text"), told, ["doc_id"], "summary", F.left("text", F.lit(2000)))
    return rows.select("doc_id", F.md5("summary").alias("summary_md5"))


_ROWS = """rows AS (SELECT doc_id, block_idx AS chunk_idx, text FROM lines),
prefix AS (SELECT doc_id, chunk_idx, CASE WHEN doc_id % 3 = 0 THEN '' WHEN chunk_idx % 2 = 0 THEN ' about ' || doc_id || ' ' END AS prefix FROM rows),
joined AS (SELECT doc_id, chunk_idx, trim(coalesce(prefix, '')) AS prefix, text FROM rows JOIN prefix USING (doc_id, chunk_idx))"""


def _prefixed(t):
    chunks = t.lines().withColumnRenamed("block_idx", "chunk_idx")
    told = F.concat(F.lit(" about "), F.col("doc_id").cast("string"), F.lit(" "))
    prefix = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("chunk_idx") % 2 == 0, told)
    return index.with_prefixes(chunks, chunks.select("doc_id", "chunk_idx", prefix.alias("prefix")), "doc_id")


@query(
    "prefixed_chunks",
    with_(LINES, _ROWS) + "SELECT doc_id, chunk_idx, prefix, CASE WHEN prefix <> '' THEN prefix || chr(10) || text ELSE text END AS text FROM joined",
)
def _(t):
    return _prefixed(t)


@query(
    "publish_gate",
    with_(LINES, _ROWS)
    + """SELECT doc_id, count(*) AS chunks, count(*) FILTER (prefix <> '') AS prefixed, count(*) FILTER (prefix <> '') >= count(*) * 0.5 AS publish FROM joined GROUP BY 1""",
)
def _(t):
    return index.publishable(_prefixed(t), "doc_id")


@query(
    "context_replies",
    """SELECT event_id AS doc_id, CAST(event_id % 7 * 3 + i AS INT) AS chunk_idx,
  CASE WHEN event_id % 3 = 2 OR i >= 2 THEN '' WHEN i = 0 THEN 'k ' || json_extract_string(props, '$.k') ELSE event_type END AS prefix
  FROM events, LATERAL (SELECT unnest(range(3)) AS i)""",
)
def _(t):
    """Replies cover three chunks but hold two contexts at most; some are unreadable."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('<think>x</think>```json\n{"contexts": [" k '), k, F.lit('", "'), "event_type", F.lit(' "]}\n```'))
    content = F.when(F.col("event_id") % 3 == 2, "sorry").otherwise(body)
    replies = spread(t.events).select(
        F.col("event_id").alias("doc_id"),
        (F.col("event_id") % 7 * 3).cast("int").alias("first_idx"),
        F.lit(3).alias("batch_size"),
        context_list(tx.strip_thinking(content)).alias("contexts"),
    )
    return index.batch_prefixes(replies, "doc_id")


@query("document_tokens", f"SELECT doc_id, md5(array_to_string({_TOKENS_SQL}, ' ')) AS tokens_md5, CAST(len({_TOKENS_SQL}) AS INT) AS n FROM documents")
def _(t):
    tk = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.md5(F.array_join(tk, " ")).alias("tokens_md5"), F.size(tk).alias("n"))


@query(
    "term_counts",
    f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY 1, 2",
)
def _(t):
    return index.postings(t.documents, ["doc_id"]).drop("len")


@query(
    "document_frequencies",
    f"SELECT source, term, count(*) AS df FROM (SELECT source, unnest(list_distinct({_TOKENS_SQL})) AS term FROM documents) GROUP BY 1, 2",
)
def _(t):
    return index.term_stats(t.documents, ["source"])


@query(
    "corpus_statistics",
    f"SELECT source, count(*) AS n_chunks, round(avg(len({_TOKENS_SQL})), 6) AS avg_len FROM documents GROUP BY 1",
)
def _(t):
    return index.corpus_stats(t.documents, ["source"]).withColumn("avg_len", F.round("avg_len", 6))


@query("text_hashes", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("text_md5"))


_THINK = "think AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<think>' || role || chr(10) || 'plan</think> ' || text ELSE text END AS text FROM conversations)"


@query("stripped_thinking", with_(_THINK) + rf"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '\A{SPACE_SQL}+|{SPACE_SQL}+\z', '', 'g') AS text FROM think")
def _(t):
    thought = F.concat(F.lit("<think>"), "role", F.lit("\nplan</think> "), "text")
    rows = F.when(F.col("turn") % 2 == 0, thought).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.strip_thinking(rows).alias("text"))


@query(
    "short_answers",
    "SELECT conv_id, turn, left(text, 120) AS text FROM conversations",
)
def _(t):
    """Optional truncation of answers before a gap request."""
    return t.conversations.select("conv_id", "turn", tx.truncated(F.col("text"), 120).alias("text"))


_WORDS = f"len(list_filter(string_split_regex(text, '{SPACE_SQL}+'), lambda t: t <> ''))"


@query("word_counts", f"SELECT doc_id, CAST({_WORDS} AS INT) AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


# --- JSON in replies -----------------------------------------------------------------

_WRAPPED = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here: ' || props || ' done'
  WHEN 3 THEN '{"a": [1, 2], "k": 3} junk' WHEN 4 THEN '[' || props || ', ' || props || ']' ELSE 'nothing' END"""


def _wrapped(t):
    n = F.col("event_id") % 6
    p = F.col("props")
    return spread(t.events).select(
        "event_id",
        F.when(n == 0, p)
        .when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Here: "), p, F.lit(" done")))
        .when(n == 3, F.lit('{"a": [1, 2], "k": 3} junk'))
        .when(n == 4, F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]")))
        .otherwise("nothing")
        .alias("reply"),
    )


@query(
    "json_in_replies",
    """SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'array' WHEN 4 THEN 'array' WHEN 5 THEN 'none' ELSE 'object' END AS kind,
  CASE WHEN event_id % 6 IN (0, 1, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 6 = 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS first_k FROM events""",
)
def _(t):
    """The array inside an object wins over the object when text follows it."""
    rows = _wrapped(t).withColumn("v", find_json(F.col("reply")))
    v = F.col("v")
    return rows.select(
        "event_id", json_kind(v).alias("kind"), json_field(v, "$.k", "long").alias("k"), json_field(v, "$[0].k", "long").alias("first_k")
    )


@query(
    "json_objects_in_replies",
    """SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 3 WHEN event_id % 6 IN (0, 1, 2) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def _(t):
    """Object-only reading of the same replies."""
    rows = _wrapped(t).withColumn("v", find_json(F.col("reply"), arrays=False))
    return rows.select("event_id", json_field(F.col("v"), "$.k", "long").alias("k"))


@query(
    "extracted_facts",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ['said by ' || role, 'turn ' || turn] ELSE []::VARCHAR[] END AS facts FROM conversations""",
)
def _(t):
    reply = F.when(
        F.col("turn") % 2 == 0,
        F.concat(F.lit('```json\n{"extracted_facts": ["said by '), "role", F.lit('", "turn '), F.col("turn").cast("string"), F.lit('"]}\n```')),
    ).otherwise("I found nothing")
    return t.conversations.select("conv_id", "turn", extracted_facts(reply).alias("facts"))


@query("page_index")
def _(t):
    """Index of all unseen pages: chunks with metadata, of the plain text where blocks give few, each
    with whether the even sample has it and whether the gate lets its page pass."""
    return build_index(t.pages, least=index.SPARSE_CHUNKS)["chunks"]

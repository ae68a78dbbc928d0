"""Queries over filings, prices, turn logs, edited answers, requests and files."""

import os
from functools import partial

from pyspark.sql import functions as F

from rubricon.catalog.base import FILINGS, SCORES, VERDICTS, query, with_
from rubricon.functions.text import trim_space
from rubricon.operators import prices, replies, search, telemetry
from rubricon.session import shared_path
from rubricon.sources import readers, writers

# --- dates and searches ----------------------------------------------------------------

_RANGES = """ranges AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '2026-3-1' ELSE strftime(o_orderdate + INTERVAL 27 YEAR, '%Y-%m-%d') END AS s,
  strftime(o_orderdate + INTERVAL 27 YEAR + to_days(CAST(o_orderkey % 60 AS INT) - 10), '%Y-%m-%d') AS e FROM orders)"""


@query(
    "clamped_date_ranges",
    with_(_RANGES)
    + r""", c AS (SELECT id, least(s, '2026-03-01') AS lo, least(e, '2026-03-01') AS hi, regexp_matches(s, '^\d{4}-\d{2}-\d{2}$') AND regexp_matches(e, '^\d{4}-\d{2}-\d{2}$') AS ok FROM ranges),
  x AS (SELECT *, CASE WHEN NOT ok THEN 'invalid date format' WHEN lo > hi THEN 'start is later than end' END AS error FROM c)
  SELECT id, CASE WHEN error IS NULL THEN lo END AS start_date, CASE WHEN error IS NULL THEN hi END AS end_date, error FROM x""",
)
def _(t):
    day = F.add_months("o_orderdate", 27 * 12)
    start = F.when(F.col("o_orderkey") % 7 == 0, "2026-3-1").otherwise(day.cast("string"))
    end = F.date_add(day, (F.col("o_orderkey") % 60).cast("int") - 10).cast("string")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), start.alias("s"), end.alias("e"))
    return rows.select("id", *search.clamped_range(F.col("s"), F.col("e")))


@query(
    "asset_routes",
    """SELECT asset, CASE WHEN lower(trim(asset)) IN ('equity', 'etf') THEN 'equity' WHEN lower(trim(asset)) IN ('crypto', 'fx') THEN lower(trim(asset)) END AS route, count(*) AS n
  FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN ' Equity ' WHEN 1 THEN 'ETF' WHEN 2 THEN 'crypto' WHEN 3 THEN 'FX ' ELSE o_orderpriority END AS asset FROM orders) GROUP BY 1, 2""",
)
def _(t):
    n = F.col("o_orderkey") % 6
    asset = F.when(n == 0, " Equity ").when(n == 1, "ETF").when(n == 2, "crypto").when(n == 3, "FX ").otherwise(F.col("o_orderpriority"))
    return t.orders.groupBy(asset.alias("asset"), search.asset_route(asset).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filing_search",
    with_(FILINGS)
    + r"""SELECT doc_id, form_type, cik, filed_at FROM filings WHERE filed_at BETWEEN DATE '2024-09-01' AND DATE '2026-03-01' AND form_type IN ('EN', 'FR')
  AND regexp_replace(cik, '^0+', '') IN ('1', '7', '12', '19')""",
)
def _(t):
    return search.filings(
        t.filings(), "2024-09-01", "2031-01-01", form_types=["EN", "FR"], ciks=["0000000001", "7", "12", "0019"]
    ).select("doc_id", "form_type", "cik", "filed_at")


_B, _A = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _m(term, prefix=False):
    return f"regexp_matches(lower(text), '{_B}{term}{'' if prefix else _A}')"


@query(
    "text_search",
    with_(FILINGS)
    + f"""SELECT doc_id, form_type FROM filings WHERE {_m('the')} AND {_m('and')} AND {_m('er', True)} AND NOT {_m('wh')}
  AND ({_m('there')} OR {_m('thion')} OR {_m('this')})""",
)
def _(t):
    match = search.text_matches(
        F.col("text"), all_of=["the", "and"], any_of=["there", "thion", "this"], none_of=["wh"], prefixes=["er"]
    )
    return t.filings().where(match).select("doc_id", "form_type")


@query(
    "phrase_search",
    with_(FILINGS) + f"SELECT doc_id FROM filings WHERE {_m('of' + chr(92) + 's+the')}",
)
def _(t):
    return t.filings().where(search.text_matches(F.col("text"), phrases=["of the"])).select("doc_id")


@query(
    "web_search",
    with_(FILINGS) + f"SELECT doc_id, filed_at AS published FROM filings WHERE filed_at BETWEEN DATE '2025-01-15' AND DATE '2025-06-30' AND {_m('with')}",
)
def _(t):
    pages = t.filings().withColumnRenamed("filed_at", "published")
    return search.web_results(pages, "2025-01-15", "2025-06-30", all_of=["with"]).select("doc_id", "published")


@query(
    "result_page",
    with_(FILINGS) + "SELECT doc_id, filed_at FROM filings ORDER BY filed_at DESC, doc_id LIMIT 10 OFFSET 100",
)
def _(t):
    return search.result_page(t.filings().select("doc_id", "filed_at"), [F.desc("filed_at"), F.asc("doc_id")], page=2, top_n=10)


# --- prices ------------------------------------------------------------------------------

_BARS = """bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, o) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, o) AS close, round(sum(value), 2) AS volume, count(*) AS tradesDone FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM events) GROUP BY 1, 2)"""


def _bars(t):
    ticks = t.events.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("value").alias("volume")
    )
    return prices.daily_bars(ticks).withColumn("volume", F.round("volume", 2))


@query("daily_bars", with_(_BARS) + "SELECT * FROM bars")
def _(t):
    return _bars(t)


@query("unnested_bars", with_(_BARS) + "SELECT symbol, date, close, volume FROM bars")
def _(t):
    """Bars packed per ticker and month as a payload and taken out again."""
    packed = _bars(t).groupBy(F.col("symbol").alias("ticker"), F.trunc("date", "month").alias("month")).agg(F.collect_list(F.struct("date", "close", "volume")).alias("priceData"))
    return prices.unnested(packed)


@query("bars_in_range", with_(_BARS) + "SELECT * FROM bars WHERE upper(symbol) = 'CLICK' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def _(t):
    return prices.in_range(_bars(t), " click ", "2024-01-05", "2024-01-20")


@query(
    "bars_as_text",
    with_(_BARS)
    + """SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(open AS VARCHAR) AS open, CAST(high AS VARCHAR) AS high, CAST(low AS VARCHAR) AS low,
  coalesce(CAST(CASE WHEN symbol <> 'view' THEN close END AS VARCHAR), 'N/A') AS close, CAST(tradesDone AS VARCHAR) AS tradesDone FROM bars""",
)
def _(t):
    """One symbol has no close; no bar has dividends, so that column is left out."""
    bars = _bars(t).drop("volume").withColumn("close", F.when(F.col("symbol") != "view", F.col("close")))
    return prices.as_text(bars.withColumn("divCash", F.lit(None).cast("double")), keep=["symbol"])


# --- turn logs and edited answers ----------------------------------------------------------

_TURNS = """turns AS (SELECT user_id AS run, event_type AS tool, value AS seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _turns(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        F.col("user_id").alias("run"),
        F.round("value", 2).alias("duration_seconds"),
        F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(0.0).alias("retry_overhead_seconds"),
        k.alias("in_tokens"),
        (k % 7).alias("out_tokens"),
        (k % 3).alias("cache_read_tokens"),
        (k / 1024).alias("cost_total"),
        F.array(F.struct(F.col("event_type").alias("name"), (k % 5 > 0).alias("success"), F.col("value").alias("seconds"))).alias("tool_calls"),
    )


@query(
    "turn_totals",
    with_(_TURNS)
    + """SELECT run, count(*) AS turns, round(sum(seconds), 2) AS duration_seconds, max(seconds) AS max_duration_seconds,
  CAST(count(*) FILTER (tool = 'error') AS DOUBLE) AS retry_overhead_seconds, CAST(sum(k) AS BIGINT) AS in_tokens, CAST(sum(k % 7) AS BIGINT) AS out_tokens,
  CAST(sum(k % 3) AS BIGINT) AS cache_read_tokens, sum(k / 1024) AS cost_total FROM turns GROUP BY 1""",
)
def _(t):
    return telemetry.turn_totals(_turns(t), ["run"]).withColumn("duration_seconds", F.round("duration_seconds", 2))


@query(
    "tool_totals",
    with_(_TURNS)
    + "SELECT tool AS name, count(*) AS calls, count(*) FILTER (k % 5 = 0) AS failures, round(sum(seconds), 2) AS tool_seconds FROM turns GROUP BY 1",
)
def _(t):
    return telemetry.tool_totals(_turns(t), []).withColumn("tool_seconds", F.round("tool_seconds", 2))


@query(
    "turn_log_totals",
    """SELECT role || ':free' AS model, 'run ' || conv_id % 3 AS run, count(*) AS turns, round(sum(length(text) / 8), 3) AS duration_seconds,
  CAST(sum(length(text)) AS BIGINT) AS in_tokens, CAST(sum(turn) AS BIGINT) AS out_tokens FROM conversations GROUP BY ALL""",
)
def _(t):
    """Every conversation turn logged as a file of its own, in folders whose names hold colons and spaces,
    and the whole tree read back."""
    folder = shared_path(t.spark, "logs").removeprefix("file://").removeprefix("file:")
    size = F.length("text")
    log = F.struct(
        (size / 8).alias("duration_seconds"),
        F.struct(F.struct(size.alias("in_tokens"), F.col("turn").alias("out_tokens")).alias("metadata")).alias("query_result"),
    )
    place = F.format_string("%s:free/run %d/q%d/turns/turn_%d", "role", F.col("conv_id") % 3, "conv_id", "turn")
    t.conversations.select(place, F.to_json(log)).foreachPartition(partial(_write_logs, folder))
    totals = telemetry.turn_totals(telemetry.flat_turns(readers.turn_log_tree(t.spark, folder)), ["model", "run"])
    return totals.select("model", "run", "turns", F.round("duration_seconds", 3).alias("duration_seconds"), "in_tokens", "out_tokens")


def _write_logs(folder, rows):
    for place, log in rows:
        os.makedirs(f"{folder}/{place}", exist_ok=True)
        with open(f"{folder}/{place}/result.json", "w", encoding="utf-8") as file:
            file.write(log)


_EDITED = r"""edited AS (SELECT conv_id, turn, len(string_split_regex(trim(text), '\s+')) AS wb, len(list_filter(string_split_regex(trim(split_part(text, '.', 1)), '\s+'), lambda w: w <> '')) AS wa FROM conversations)"""


def _edited(t):
    return telemetry.compression(
        t.conversations.select("conv_id", "turn", F.col("text").alias("before"), F.substring_index("text", ".", 1).alias("after"))
    )


@query(
    "answer_compression",
    with_(_EDITED) + "SELECT conv_id, turn, CAST(wb AS INT) AS words_before, CAST(wa AS INT) AS words_after, round(100.0 * wa / wb, 1) AS retained_pct FROM edited",
)
def _(t):
    return _edited(t).select("conv_id", "turn", "words_before", "words_after", "retained_pct")


@query(
    "compression_ratio",
    with_(_EDITED) + "SELECT CAST(sum(wb) AS BIGINT) AS words_before, CAST(sum(wa) AS BIGINT) AS words_after, round(sum(wa) / sum(wb), 4) AS compression_ratio FROM edited",
)
def _(t):
    return telemetry.compression_total(_edited(t))


# --- requests and replies -------------------------------------------------------------------

_REQ = """req AS (SELECT conv_id, turn, 'Question from ' || role || ': ' || text AS prompt FROM conversations)"""


def _requests(t):
    prompt = replies.render("Question from {role}: {text}", role=F.col("role"), text=F.col("text"))
    return replies.request_rows(t.conversations, "answer", ["conv_id", "turn"], prompt)


@query(
    "rendered_requests",
    with_(_REQ) + "SELECT sha256('answer' || chr(31) || conv_id || chr(31) || turn) AS request_id, 'answer' AS stage, conv_id, turn, prompt FROM req",
)
def _(t):
    return _requests(t)


@query(
    "scored_requests",
    with_(_REQ)
    + """SELECT conv_id, turn, CASE WHEN length(prompt) % 2 = 0 THEN length(prompt) END AS n,
  CASE WHEN length(prompt) % 2 = 1 THEN 'no JSON in reply' END AS error FROM req""",
)
def _(t):
    """A deterministic stand-in answers every prompt; half of its replies are unreadable."""
    from rubricon.functions.jsontext import json_field

    def answer(prompts):
        return [f'{{"n": {len(p)}}}' if len(p) % 2 == 0 else "no idea" for p in prompts]

    requests = _requests(t)
    read = replies.read_replies(requests, replies.score_requests(requests, answer, batch=32))
    return read.select("conv_id", "turn", json_field(F.col("value"), "$.n", "long").alias("n"), "error")


@query(
    "usable_replies",
    """SELECT l_orderkey AS request_id, arg_max('part ' || l_partkey, pos) AS content FROM
  (SELECT *, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R') GROUP BY 1""",
)
def _(t):
    """Line items are attempts; some failed, some were cut off."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("request_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("attempt"),
        F.when(F.col("l_linestatus") == "F", "ok").otherwise("failed").alias("status"),
        F.when(F.col("l_returnflag") == "R", "length").otherwise("stop").alias("finish_reason"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("content"),
    )
    return replies.usable(rows)


_DEAD = with_(VERDICTS) + """, d AS (SELECT question, tier, CASE WHEN tier = 'optional' AND NOT met THEN 'unknown category' END AS error FROM verdicts)
  SELECT 'good' AS side, tier, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM d WHERE error IS NULL GROUP BY 2
  UNION ALL SELECT 'failed', tier, count(*), error FROM d WHERE error IS NOT NULL GROUP BY 2, 4"""


@query("dead_letters", _DEAD)
def _(t):
    """Good and failed rows after a split by error, written apart and counted."""
    error = F.when((F.col("tier") == "optional") & ~F.col("met"), "unknown category")
    rows = t.verdicts().select("question", "tier", error.alias("error"))
    good_path, bad_path = shared_path(t.spark, "good"), shared_path(t.spark, "failed")
    writers.with_dead_letters(rows, good_path, bad_path)
    good, bad = t.spark.read.parquet(good_path), t.spark.read.schema("question long, tier string, error string").json(bad_path)
    count = F.count(F.lit(1)).alias("n")
    return (
        good.groupBy("tier").agg(count).select(F.lit("good").alias("side"), "tier", "n", F.lit(None).cast("string").alias("error"))
        .unionByName(bad.groupBy("tier", "error").agg(count).select(F.lit("failed").alias("side"), "tier", "n", "error"))
    )


# --- files --------------------------------------------------------------------------------


@query(
    "answers_from_files",
    """SELECT role AS model, count(*) AS answers, count(*) FILTER (length(text) > 200) AS successes, CAST(sum(CASE WHEN length(text) > 200 THEN length(text) END) AS BIGINT) AS chars FROM conversations GROUP BY 1""",
)
def _(t):
    """Answer runs written as JSON lines per model and read back with their schema."""
    ok = F.length("text") > 200
    error = F.struct(
        F.lit("Timeout").alias("type"), F.lit("late").alias("message"), F.lit(None).cast("string").alias("traceback"),
        F.struct(F.lit(50).alias("max_turns")).alias("context"),
    )
    rows = t.conversations.select(
        F.col("role").alias("model"), F.concat_ws("/", "conv_id", "turn").alias("question"), ok.alias("success"),
        F.when(ok, F.col("text")).alias("answer"), F.when(~ok, error).alias("error"),
    )
    path = shared_path(t.spark, "answers")
    writers.json_lines(rows, path, partition="model")
    return (
        readers.partitioned_answers(t.spark, path)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("answers"), F.count_if("success").alias("successes"), F.sum(F.length("answer")).alias("chars"))
    )


@query(
    "grades_from_files",
    """SELECT 'Line ' || l_returnflag AS model, count(*) AS graded, round(avg(l_discount), 6) AS average FROM lineitem GROUP BY 1""",
)
def _(t):
    """Grade documents, one per line item run, exploded into graded questions."""
    result = F.struct(F.col("l_orderkey").cast("string").alias("question"), F.col("l_discount").alias("score"))
    rows = t.lineitem.select(F.concat(F.lit("Line "), "l_returnflag").alias("model"), F.array(result).alias("results"))
    path = shared_path(t.spark, "grades")
    writers.json_lines(rows, path)
    return (
        readers.grades(t.spark, path, multiline=False)
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("graded"), F.round(F.avg("score"), 6).alias("average"))
    )


@query(
    "rubrics_from_keyed_files",
    """SELECT p_name || ' ' || p_partkey AS question, p_brand AS category, CAST(p_size AS DOUBLE) AS critical_weight,
  p_size % 4 AS critical, p_type AS optional FROM part""",
)
def _(t):
    """Rubrics written as objects of records, twenty to a line, and read back."""
    size = F.col("p_size")
    record = F.struct(
        F.concat_ws(" ", "p_name", "p_partkey").alias("question"),
        F.col("p_brand").alias("category"),
        F.struct(size.cast("double").alias("critical")).alias("weights"),
        F.struct(F.array_repeat(F.lit("fact"), size % 4).alias("critical"), F.array("p_type").alias("optional")).alias("rubric"),
    )
    keyed = t.part.groupBy(F.floor(F.col("p_partkey") / 20)).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), record))).alias("m")
    )
    path = shared_path(t.spark, "keyed-rubrics")
    keyed.select(F.to_json("m").alias("value")).write.text(path)
    return readers.keyed_rubrics(t.spark, path, multiline=False).select(
        "question",
        "category",
        F.col("weights.critical").alias("critical_weight"),
        F.size("rubric.critical").alias("critical"),
        F.col("rubric.optional")[0].alias("optional"),
    )


@query(
    "facts_from_files",
    """SELECT o_orderpriority AS model, o_orderstatus AS question, count(DISTINCT year(o_orderdate)) AS facts FROM orders GROUP BY 1, 2""",
)
def _(t):
    """Facts files, one record per model and question; every model must cover as many questions."""
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("question")).agg(
        F.collect_set(F.year("o_orderdate").cast("string")).alias("facts")
    )
    path = shared_path(t.spark, "facts")
    writers.json_lines(rows, path)
    return readers.facts(t.spark, path, multiline=False).select("model", "question", F.size("facts").cast("long").alias("facts"))


@query("taxonomy_from_csv", "SELECT p_name || ', \"' || p_brand || '\"' AS question, p_type AS proposed_domain, p_brand AS proposed_workflow FROM part")
def _(t):
    """Questions with commas and quotes survive a CSV round trip."""
    rows = t.part.select(
        F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("question"),
        F.col("p_type").alias("proposed_domain"),
        F.col("p_brand").alias("proposed_workflow"),
    )
    path = shared_path(t.spark, "taxonomy")
    rows.write.csv(path, header=True, escape='"')
    return readers.taxonomy(t.spark, path)


@query(
    "question_lines",
    "SELECT trim(l) AS question FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''",
)
def _(t):
    """Document lines written as text and read as a question list."""
    path = shared_path(t.spark, "questions")
    t.documents.select(F.concat(F.lit(" "), "text", F.lit("\n")).alias("value")).write.text(path)
    return readers.questions(t.spark, path)


@query(
    "report_files",
    with_(SCORES) + "SELECT domain, model, CAST(count(*) AS VARCHAR) AS n FROM scores GROUP BY 1, 2",
)
def _(t):
    """A report written as CSV and read back as text."""
    from rubricon.operators.reports import group_scores

    path = shared_path(t.spark, "reports")
    writers.reports({"domain_scores": group_scores(t.scores(), "domain")}, path)
    back = t.spark.read.csv(f"{path}/domain_scores", header=True)
    return back.select("domain", "model", trim_space(F.col("count")).alias("n"))

"""Grading queries: verdicts, roll-up, gating, ensembles, answers."""

from pyspark.sql import functions as F

from rubricon.catalog.base import CATEGORY, CRITERIA, VERDICTS, WEIGHTS, query, with_
from rubricon.functions.jsontext import category_reply, hallucination, quality_reply, verdict
from rubricon.operators import grading
from rubricon.operators.grouping import spread
from rubricon.plans.grade import grade_answers

_COUNTS = f"""counted AS (SELECT o_orderpriority AS model, o_orderkey AS question, {CATEGORY} AS category, bool_or(o_orderstatus = 'P') AS h,
  count(*) FILTER (tier = 'critical' AND met) AS cm, count(*) FILTER (tier = 'critical') AS ca,
  count(*) FILTER (tier = 'important' AND met) AS im, count(*) FILTER (tier = 'important') AS ia,
  count(*) FILTER (tier = 'optional' AND met) AS om, count(*) FILTER (tier = 'optional') AS oa
  FROM orders LEFT JOIN criteria ON question = o_orderkey GROUP BY 1, 2, 3)"""


def _scored(penalty):
    return f"""points AS (SELECT c.*, cm * w_c AS ce, ca * w_c AS cp, im * w_i AS ie, ia * w_i AS ip, om * w_o AS oe, oa * w_o AS op,
  CASE WHEN h THEN {penalty} ELSE 0.0::DOUBLE END AS pen FROM counted c LEFT JOIN weights USING (category)),
scored AS (SELECT *, greatest(0.0, ce + ie + oe + pen) AS raw, cp + ip + op AS mx FROM points),
graded AS (SELECT *, CASE WHEN mx > 0 THEN round(raw / mx, 4) ELSE 0.0::DOUBLE END AS ungated FROM scored)"""


_BASE = with_(CRITERIA, WEIGHTS, _COUNTS, _scored("-abs(w_h)"))
_GATED = ", gated AS (SELECT *, ca > cm OR h AS failed, ca + ia + oa = cm + im + om AND NOT h AS pass FROM graded)"
_ROLL = """SELECT model, question, category, h AS hallucination_detected, ce AS critical_earned, cp AS critical_possible,
  ie AS important_earned, ip AS important_possible, oe AS optional_earned, op AS optional_possible,
  pen AS hallucination_penalty, raw AS raw_score, mx AS max_score, ungated AS normalized, ungated AS score FROM graded"""


def _rolled(t, **kw):
    return grading.roll_up(t.criteria(), ["question"], t.questions(), **kw)


def _shown(df):
    return df.drop("critical_unmet", "important_unmet", "optional_unmet")


@query("score_roll_up", _BASE + _ROLL)
def _(t):
    return _shown(_rolled(t))


@query("score_roll_up_signed", with_(CRITERIA, WEIGHTS, _COUNTS, _scored("w_h")) + _ROLL)
def _(t):
    return _shown(_rolled(t, signed_penalty=True))


@query(
    "gated_scores",
    _BASE
    + _GATED
    + """ SELECT model, question, raw AS raw_score, mx AS max_score, ungated AS ungated_normalized, failed AS dealbreaker_failed,
  CASE WHEN pass THEN 1.0 ELSE 0.0 END::DOUBLE AS all_pass, CASE WHEN failed THEN 0.0 ELSE ungated END AS score FROM gated""",
)
def _(t):
    return grading.gate(_rolled(t)).select(
        "model", "question", "raw_score", "max_score", "ungated_normalized", "dealbreaker_failed", "all_pass", "score"
    )


@query(
    "run_summary",
    _BASE
    + """SELECT model, count(*) AS count, round(avg(ungated), 4) AS average_score, round(min(ungated), 4) AS min_score,
  round(max(ungated), 4) AS max_score FROM graded GROUP BY model""",
)
def _(t):
    return grading.run_summary(_rolled(t))


@query(
    "gated_summary",
    _BASE
    + _GATED
    + """ SELECT model, count(*) AS count, round(avg(CASE WHEN failed THEN 0.0 ELSE ungated END), 4) AS avg_gated,
  round(avg(ungated), 4) AS avg_ungated, round(avg(CASE WHEN pass THEN 1.0 ELSE 0.0 END), 4) AS avg_all_pass,
  'critical' AS dealbreaker_tier FROM gated GROUP BY model""",
)
def _(t):
    return grading.gated_summary(grading.gate(_rolled(t)))


@query(
    "gated_summary_important",
    _BASE
    + """, gated AS (SELECT *, ia > im OR h AS failed, ca + ia + oa = cm + im + om AND NOT h AS pass FROM graded)
  SELECT model, count(*) AS count, round(avg(CASE WHEN failed THEN 0.0 ELSE ungated END), 4) AS avg_gated,
  round(avg(ungated), 4) AS avg_ungated, round(avg(CASE WHEN pass THEN 1.0 ELSE 0.0 END), 4) AS avg_all_pass,
  'important' AS dealbreaker_tier FROM gated GROUP BY model""",
)
def _(t):
    return grading.gated_summary(grading.gate(_rolled(t), "important"), dealbreaker="important")


_VOTES = """votes AS (SELECT l_orderkey AS question, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS judge,
  CASE WHEN l_linestatus = 'F' THEN 'MET' ELSE 'UNMET' END AS verdict, 'part ' || l_partkey AS reason, l_returnflag = 'R' AS hallucination
  FROM lineitem)"""


@query(
    "judge_majority",
    with_(_VOTES)
    + """SELECT question, count(*) FILTER (verdict = 'MET') > 1.5 AS met, count(*) AS votes, arg_min(reason, judge) AS reason,
  count(*) FILTER (hallucination) > 1.5 AS hallucination_detected FROM votes GROUP BY question""",
)
def _(t):
    """Line items vote on their order; a call that failed left no row."""
    votes = t.lineitem.select(
        F.col("l_orderkey").alias("question"),
        (F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("judge"),
        F.when(F.col("l_linestatus") == "F", "MET").otherwise("UNMET").alias("verdict"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("reason"),
        (F.col("l_returnflag") == "R").alias("hallucination"),
    )
    return grading.majority(votes, ["question"], judges=3)


_REPLIES = """replies AS (SELECT p_partkey AS part, p_size % 2 = 0 AS met,
  CASE WHEN p_size % 5 > 0 THEN 'size ' || p_size END AS reason FROM part WHERE p_size % 3 > 0)"""


@query(
    "verdict_attach",
    with_(_REPLIES)
    + """SELECT l_orderkey AS question, l_linenumber AS pos, l_partkey AS part, coalesce(met, false) AS met,
  CASE WHEN met IS NULL THEN 'judge failure: no reply' ELSE coalesce(reason, '') END AS reason
  FROM lineitem LEFT JOIN replies ON part = l_partkey""",
)
def _(t):
    """Judge replies exist for some parts only; the others count as failed calls."""
    replies = t.part.where(F.col("p_size") % 3 > 0).select(
        F.col("p_partkey").alias("part"),
        (F.col("p_size") % 2 == 0).alias("met"),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("reason"),
        F.lit(None).cast("string").alias("failure"),
    )
    criteria = t.lineitem.select(
        F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part")
    )
    return grading.attach_verdicts(criteria, replies, ["part"])


@query(
    "weight_lookup",
    with_(VERDICTS, WEIGHTS)
    + """, cats AS (SELECT question, CASE WHEN tier = 'optional' THEN 'other' ELSE category END AS category FROM verdicts)
  SELECT category, count(*) AS criteria, any_value(w_c) AS critical, any_value(w_h) AS hallucination, bool_or(w_c IS NULL) AS unknown
  FROM cats LEFT JOIN weights USING (category) GROUP BY category""",
)
def _(t):
    """Unknown categories come out without weights, for the dead-letter split."""
    cats = t.verdicts().withColumn("category", F.when(F.col("tier") == "optional", "other").otherwise(F.col("category")))
    return grading.with_weights(cats).groupBy("category").agg(
        F.count(F.lit(1)).alias("criteria"),
        F.first("weights.critical", ignorenulls=True).alias("critical"),
        F.first("weights.hallucination", ignorenulls=True).alias("hallucination"),
        F.max(F.col("weights").isNull()).alias("unknown"),
    )


@query(
    "rubric_answer_pairs",
    """WITH r AS (SELECT o_orderkey AS question, o_orderpriority AS rubric FROM orders),
  a AS (SELECT o_orderkey AS question, o_orderstatus AS answer FROM orders)
  SELECT question, rubric, answer FROM r JOIN a USING (question)""",
)
def _(t):
    r = t.orders.select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("rubric"))
    a = t.orders.select(F.col("o_orderkey").alias("question"), F.col("o_orderstatus").alias("answer"))
    return grading.pair_with_answers(r, a)


_FIELDS = """fields AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' WHEN turn % 2 = 1 THEN text END AS answer,
  CASE WHEN turn % 3 = 0 THEN text ELSE '' END AS model_answer, CASE WHEN role = 'system' THEN NULL WHEN turn > 1 THEN role END AS response,
  CASE WHEN role = 'user' THEN upper(role) END AS output FROM conversations)"""


@query(
    "answer_field_choice",
    with_(_FIELDS)
    + """SELECT conv_id, turn, coalesce(nullif(answer, ''), nullif(model_answer, ''), nullif(response, ''), nullif(output, ''), '') AS answer_text
  FROM fields""",
)
def _(t):
    role, turn = F.col("role"), F.col("turn")
    fields = t.conversations.select(
        "conv_id",
        "turn",
        F.when(role == "user", "").when(turn % 2 == 1, F.col("text")).alias("answer"),
        F.when(turn % 3 == 0, F.col("text")).otherwise("").alias("model_answer"),
        F.when(role == "system", None).when(turn > 1, role).alias("response"),
        F.when(role == "user", F.upper("role")).alias("output"),
    )
    return fields.select("conv_id", "turn", grading.answer_text(fields).alias("answer_text"))


_RUNS = """runs AS (SELECT role AS model, conv_id || '/' || turn AS question, length(text) > 200 AS success, text AS final_answer,
  CASE WHEN length(text) < 50 THEN 'too short' END AS error, 'turn limit' AS final_error FROM conversations)"""
_ROWS = "rows AS (SELECT model, question, success, CASE WHEN success THEN final_answer END AS answer, coalesce(error, final_error) AS error FROM runs)"


def _runs(t):
    return t.conversations.select(
        F.col("role").alias("model"),
        F.concat_ws("/", "conv_id", "turn").alias("question"),
        (F.length("text") > 200).alias("success"),
        F.col("text").alias("final_answer"),
        F.when(F.length("text") < 50, "too short").alias("error"),
        F.lit("turn limit").alias("final_error"),
    )


@query("answer_rows", with_(_RUNS, _ROWS) + "SELECT * FROM rows")
def _(t):
    return grading.answer_rows(_runs(t))


@query("answered_rows", with_(_RUNS, _ROWS) + "SELECT * FROM rows WHERE success AND answer <> ''")
def _(t):
    return grading.answered(grading.answer_rows(_runs(t)))


_JUDGE = """judge AS (SELECT event_id, CASE event_id % 4
  WHEN 0 THEN '{"verdict": "MET", "reason": "k ' || json_extract_string(props, '$.k') || '"}'
  WHEN 1 THEN '```json' || chr(10) || '{"verdict": "PARTLY", "hallucination": true, "k": ' || json_extract_string(props, '$.k') || '}' || chr(10) || '```'
  WHEN 2 THEN 'I think {"verdict": "UNMET"} fits' ELSE 'no verdict here' END AS reply FROM events)"""


def _judge(t):
    k = F.get_json_object("props", "$.k")
    n = F.col("event_id") % 4
    return spread(t.events).select(
        "event_id",
        F.when(n == 0, F.concat(F.lit('{"verdict": "MET", "reason": "k '), k, F.lit('"}')))
        .when(n == 1, F.concat(F.lit('```json\n{"verdict": "PARTLY", "hallucination": true, "k": '), k, F.lit("}\n```")))
        .when(n == 2, F.lit('I think {"verdict": "UNMET"} fits'))
        .otherwise("no verdict here")
        .alias("reply"),
    )


@query(
    "judge_reply_parse",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS met,
  CASE event_id % 4 WHEN 0 THEN 'k ' || json_extract_string(props, '$.k') WHEN 3 THEN NULL ELSE '' END AS reason,
  event_id % 4 = 1 AS hallucination FROM events""",
)
def _(t):
    v = verdict(F.col("reply"))
    return _judge(t).select(
        "event_id", v["met"].alias("met"), v["reason"].alias("reason"), hallucination(F.col("reply")).alias("hallucination")
    )


_MODELS = ("alpha", "beta", "gamma", "delta", "epsilon")


@query(
    "graded_answers",
    with_(CRITERIA, WEIGHTS)
    + f""", models AS (SELECT unnest(range(5)) AS m, unnest({list(_MODELS)}) AS model),
  a AS (SELECT o_orderkey AS question, model, m, (o_orderkey + m) % 7 = 0 AS h, CASE left(o_orderpriority, 1) WHEN '1' THEN 'quantitative'
    WHEN '2' THEN 'disclosure' WHEN '3' THEN 'governance' WHEN '4' THEN 'forensic' ELSE 'modeling' END AS category FROM orders, models),
  v AS (SELECT l_orderkey AS question, model, CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'important' ELSE 'optional' END AS tier,
    (p_size + m) % 3 > 0 AND (p_size + m) % 2 = 0 AS met FROM lineitem JOIN part ON p_partkey = l_partkey, models),
  s AS (SELECT model, question, h, greatest(0.0, coalesce(sum(CASE WHEN met THEN CASE tier WHEN 'critical' THEN w_c WHEN 'important' THEN w_i ELSE w_o END ELSE 0 END), 0)
      + CASE WHEN h THEN -abs(any_value(w_h)) ELSE 0 END) AS raw,
    coalesce(sum(CASE tier WHEN 'critical' THEN w_c WHEN 'important' THEN w_i WHEN 'optional' THEN w_o END), 0) AS mx,
    coalesce(bool_or(tier = 'critical' AND NOT met), false) OR h AS failed, coalesce(bool_and(met), true) AND NOT h AS pass
    FROM a LEFT JOIN v USING (question, model) JOIN weights USING (category) GROUP BY 1, 2, 3),
  r AS (SELECT *, CASE WHEN mx > 0 THEN round(raw / mx, 4) ELSE 0 END AS score FROM s)
  SELECT model, count(*) AS count, round(avg(CASE WHEN failed THEN 0 ELSE score END), 4) AS avg_gated,
  round(avg(score), 4) AS avg_ungated, round(avg(CASE WHEN pass THEN 1.0 ELSE 0.0 END), 4) AS avg_all_pass,
  'critical' AS dealbreaker_tier FROM r GROUP BY model""",
)
def _(t):
    """From criteria and judge replies to the gated run summary in one plan. All five models answer
    every order; orders without a line have no criteria."""
    from rubricon.catalog.base import category_of, tier_of

    models = F.posexplode(F.array(*[F.lit(m) for m in _MODELS])).alias("m", "model")
    criteria = t.lineitem.select(
        F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("part"), tier_of("l_returnflag").alias("tier")
    )
    answers = t.orders.select(F.col("o_orderkey").alias("question"), category_of("o_orderpriority").alias("category"), models)
    answers = answers.select("question", "model", "category", ((F.col("question") + F.col("m")) % 7 == 0).alias("hallucination"))
    size = F.col("p_size") + F.col("m")
    replies = t.part.select("p_partkey", "p_size", models).where(size % 3 > 0).select(
        F.col("p_partkey").alias("part"),
        "model",
        (size % 2 == 0).alias("met"),
        F.lit("").alias("reason"),
        F.lit(None).cast("string").alias("failure"),
    )
    # Many lines share the replies to a part; five models to a part are more than Spark expects of the file.
    return grade_answers(criteria, answers, replies.hint("shuffle_hash"), ["model", "part"])["gated_summary"]


_NUMBERS = "SELECT p_partkey, p_name, p_size, p_size % 51 + p_partkey % 49 AS a, p_partkey % 90 + 10 AS b FROM part"


@query(
    "quality_replies",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN a / 100.0::DOUBLE END AS specificity, CASE WHEN p_partkey % 7 > 0 THEN b / 100.0::DOUBLE END AS coverage,
  CASE WHEN p_partkey % 7 > 0 AND p_size % 2 = 0 THEN 0.5::DOUBLE END AS overall, CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END END AS issues,
  CASE WHEN p_partkey % 7 > 0 AND p_size % 2 = 0 THEN p_name END AS first_issue FROM ({_NUMBERS})""",
)
def _(t):
    """Replies of a quality check: bare, fenced, without a list or without JSON."""
    a, b = F.col("p_size") % 51 + F.col("p_partkey") % 49, F.col("p_partkey") % 90 + 10
    number = lambda n: F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))
    tail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', "overall": 0.5, "issues": ["'), "p_name", F.lit('"]}'))).otherwise("}")
    body = F.concat(F.lit('{"scores": {"specificity": '), number(a), F.lit(', "coverage": '), number(b), F.lit("}"), tail)
    n = F.col("p_partkey")
    reply = F.when(n % 7 == 0, "nothing to say").when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    read = t.part.select("p_partkey", quality_reply(reply).alias("q"))
    return read.select(
        "p_partkey", "q.specificity", "q.coverage", "q.overall", F.when(F.col("q").isNotNull(), F.size("q.issues")).alias("issues"), F.get("q.issues", F.lit(0)).alias("first_issue")
    )


@query(
    "category_replies",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN ['quantitative', 'forensic'][CAST(o_orderkey % 2 + 1 AS INT)] END AS category,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'no category' ELSE 'unknown category other' END END AS error FROM orders""",
)
def _(t):
    """Replies of a classifier: known names, an unknown one, and text without JSON."""
    n = F.col("o_orderkey")
    name = F.when(n % 3 == 0, "other").when(n % 2 == 0, "quantitative").otherwise("forensic")
    reply = F.when(n % 6 == 0, "I cannot say").otherwise(F.concat(F.lit('Sure: {"category": "'), name, F.lit('"}')))
    return t.orders.select("o_orderkey", category_reply(reply, list(grading.CATEGORIES)).alias("c")).select("o_orderkey", "c.*")

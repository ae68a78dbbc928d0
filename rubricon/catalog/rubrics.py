"""Queries over rubrics: assembly, validation, repair, de-duplication, routing."""

from pyspark.sql import functions as F

from rubricon.catalog.base import ORIGINAL, QUALITY, REPAIRED, query, with_
from rubricon.functions.text import signals
from rubricon.operators import rubrics
from rubricon.operators.grouping import spread
from rubricon.plans.rubrics import dedupe_rubric, repair_round, rubric_from_replies

_O, _OR = with_(ORIGINAL), with_(ORIGINAL, REPAIRED)
_Q = with_(QUALITY)


def _nested(t):
    """Document lines as a record: every third line to the next tier."""
    lines = F.split("text", "\n")
    part = lambda n: F.filter(lines, lambda s, i: i % 3 == n)
    return t.documents.select(
        F.col("doc_id").alias("question"), part(0).alias("critical"), part(1).alias("important"), part(2).alias("optional")
    )


_NESTED = """nested AS (SELECT doc_id AS question,
  list_transform(list_filter(range(len(l)), lambda i: i % 3 = 0), lambda i: l[i + 1]) AS critical,
  list_transform(list_filter(range(len(l)), lambda i: i % 3 = 1), lambda i: l[i + 1]) AS important,
  list_transform(list_filter(range(len(l)), lambda i: i % 3 = 2), lambda i: l[i + 1]) AS optional
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    "rubric_stats",
    with_(_NESTED)
    + """SELECT question, CAST(len(critical) AS INT) AS n_critical, CAST(len(important) AS INT) AS n_important,
  CAST(len(optional) AS INT) AS n_optional, CAST(len(critical) + len(important) + len(optional) AS INT) AS total FROM nested""",
)
def _(t):
    return rubrics.stats(_nested(t))


@query(
    "rubric_flat_rows",
    with_(_NESTED)
    + """SELECT question, 'critical' AS tier, i AS pos, critical[i + 1] AS fact FROM nested, LATERAL (SELECT CAST(unnest(range(len(critical))) AS INT) AS i)
  UNION ALL SELECT question, 'important', i, important[i + 1] FROM nested, LATERAL (SELECT CAST(unnest(range(len(important))) AS INT) AS i)
  UNION ALL SELECT question, 'optional', i, optional[i + 1] FROM nested, LATERAL (SELECT CAST(unnest(range(len(optional))) AS INT) AS i)""",
)
def _(t):
    return rubrics.flat(_nested(t))


_COUNTS = """counts AS (SELECT question, count(*) FILTER (tier = 'critical') AS n_critical, count(*) FILTER (tier = 'important') AS n_important,
  count(*) FILTER (tier = 'optional') AS n_optional, count(*) AS total FROM original GROUP BY 1)"""


@query(
    "rubric_shape_warnings",
    with_(ORIGINAL, _COUNTS)
    + """SELECT *, total > 0 AND n_critical > 0.8 * total AS mostly_critical, total > 0 AND n_optional = 0 AS no_optional FROM counts""",
)
def _(t):
    return rubrics.shape_warnings(rubrics.flat_stats(t.original()))


@query(
    "rubric_validation",
    _OR
    + """, a AS (SELECT question, fact, count(*) AS n FROM repaired GROUP BY 1, 2), w AS (SELECT DISTINCT question, fact FROM original),
  b AS (SELECT coalesce(a.question, w.question) AS question, a.n, w.fact AS wf FROM a FULL JOIN w ON a.question = w.question AND a.fact = w.fact),
  c AS (SELECT question, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (wf IS NULL) AS extra,
    CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM b GROUP BY 1)
  SELECT *, CASE WHEN missing > 0 THEN 'omitted facts' WHEN extra > 0 THEN 'unknown facts' WHEN duplicates > 0 THEN 'duplicate facts' END AS error FROM c""",
)
def _(t):
    return rubrics.validation(t.repaired(), t.original().select("question", "fact"))


@query(
    "rubric_reassignment",
    _OR
    + r""", facts AS (SELECT question, fact, min(pos) AS pos FROM original GROUP BY 1, 2),
  induced AS (SELECT question, tier, pos, CASE WHEN pos % 2 = 0 THEN '  ' || upper(replace(fact, ' ', '  ')) ELSE fact END AS fact FROM repaired),
  src AS (SELECT question, lower(fact) AS f, fact FROM facts),
  mapped AS (SELECT i.question, tier, pos, s.fact FROM induced i JOIN src s ON s.question = i.question
    AND s.f = trim(regexp_replace(lower(i.fact), '\s+', ' ', 'g'))),
  kept AS (SELECT question, tier, min(pos) AS pos, fact FROM mapped GROUP BY question, tier, fact)
  SELECT question, tier, pos, fact, false AS appended FROM kept UNION ALL
  SELECT question, 'important', pos, fact, true FROM facts f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.question = f.question AND k.fact = f.fact)""",
)
def _(t):
    """Induced criteria in other case and spacing go back onto their facts."""
    facts = t.original().groupBy("question", "fact").agg(F.min("pos").alias("pos"))
    loose = F.concat(F.lit("  "), F.upper(F.replace("fact", F.lit(" "), F.lit("  "))))
    induced = t.repaired().withColumn("fact", F.when(F.col("pos") % 2 == 0, loose).otherwise(F.col("fact")))
    return rubrics.repaired_assignment(induced, facts)


@query(
    "new_facts",
    _OR
    + "SELECT question, tier, pos, fact FROM repaired r WHERE NOT EXISTS (SELECT 1 FROM original o WHERE o.question = r.question AND o.fact = r.fact)",
)
def _(t):
    return rubrics.new_facts(t.repaired(), t.original()).select("question", "tier", "pos", "fact")


@query(
    "answer_lookup",
    """SELECT o_orderkey AS request, o_custkey AS question, a.answer_file, a.answer FROM orders
  JOIN (SELECT l_returnflag AS answer_file, l_suppkey AS question, arg_min(l_comment, pos) AS answer FROM
    (SELECT l_returnflag, l_suppkey, 'part ' || l_partkey AS l_comment, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pos FROM lineitem) GROUP BY 1, 2) a
  ON a.question = o_custkey AND a.answer_file = CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END""",
)
def _(t):
    """First answer to a question in the named file; orders ask, line items answer."""
    status = F.col("o_orderstatus")
    requests = t.orders.select(
        F.col("o_orderkey").alias("request"),
        F.col("o_custkey").alias("question"),
        F.when(status == "F", "A").when(status == "O", "N").otherwise("R").alias("answer_file"),
    )
    answers = t.lineitem.select(
        F.col("l_returnflag").alias("answer_file"),
        F.col("l_suppkey").alias("question"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("answer"),
    )
    return rubrics.lookup_answers(requests, answers).select("request", "question", "answer_file", "answer")


_POOL = """pool AS (SELECT question, CAST(regexp_extract(fact, 'Part (\\d+)', 1) AS BIGINT) % 7 AS cluster_id, pos, fact FROM repaired),
tiers AS (SELECT question, fact, max(CASE tier WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END) AS p FROM original GROUP BY 1, 2),
merged AS (SELECT question, cluster_id, min(coalesce(p, 2)) AS p, count(*) AS members, arg_max(fact, length(fact) * 1000 - pos) AS fact
  FROM pool LEFT JOIN tiers USING (question, fact) GROUP BY 1, 2)""".replace("\\\\", "\\")


def _pool(t):
    part = F.regexp_extract("fact", r"Part (\d+)", 1).cast("long")
    return t.repaired().withColumn("cluster_id", part % 7).select("question", "cluster_id", "pos", "fact").distinct()


@query(
    "cluster_tiers",
    with_(ORIGINAL, REPAIRED, _POOL.replace("SELECT question, CAST(reg", "SELECT DISTINCT question, CAST(reg"))
    + "SELECT question, cluster_id, ['critical', 'important', 'optional'][CAST(p + 1 AS INT)] AS tier, members, length(fact) AS fact_length FROM merged",
)
def _(t):
    """Criteria that fall into one cluster keep the highest tier any of them had."""
    out = rubrics.cluster_tiers(_pool(t), t.original())
    return out.select("question", "cluster_id", "tier", "members", F.length("fact").alias("fact_length"))


@query(
    "deduped_rubric_stats",
    with_(ORIGINAL, REPAIRED, _POOL.replace("SELECT question, CAST(reg", "SELECT DISTINCT question, CAST(reg"))
    + """SELECT question, count(*) FILTER (p = 0) AS n_critical, count(*) FILTER (p = 1) AS n_important, count(*) FILTER (p = 2) AS n_optional,
  count(*) AS total FROM merged GROUP BY 1""",
)
def _(t):
    return dedupe_rubric(t.original(), _pool(t))["stats"]


_CONTRA = """totals AS (SELECT question, year_bucket AS cluster_id, count(DISTINCT model) AS agreement_count FROM
  (SELECT n_name AS question, o_orderpriority AS model, CAST(floor(o_totalprice / 1000) AS BIGINT) AS year_bucket
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2),
pairs AS (SELECT a.question, a.cluster_id AS ca, b.cluster_id AS cb, a.agreement_count AS na, b.agreement_count AS nb
  FROM totals a JOIN totals b ON a.question = b.question AND b.cluster_id = a.cluster_id + 1 WHERE a.cluster_id % 3 = 0),
losers AS (SELECT question, ca AS cluster_id, na = nb AS tie FROM pairs WHERE na <= nb
  UNION ALL SELECT question, cb, na = nb FROM pairs WHERE nb <= na)"""


@query(
    "contradictions",
    with_(_CONTRA)
    + """SELECT t.question, t.cluster_id, t.agreement_count, CASE WHEN l.tie IS NULL THEN 'kept' WHEN l.tie THEN 'review' ELSE 'dropped' END AS outcome
  FROM totals t LEFT JOIN (SELECT question, cluster_id, bool_or(tie) AS tie FROM losers GROUP BY 1, 2) l
  ON l.question = t.question AND l.cluster_id = t.cluster_id""",
)
def _(t):
    """Neighbouring amounts of one question contradict each other."""
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("question"),
            F.col("o_orderpriority").alias("model"),
            F.floor(F.col("o_totalprice") / 1000).alias("cluster_id"),
        )
    )
    totals = rows.groupBy("question", "cluster_id").agg(F.count_distinct("model").alias("agreement_count"))
    pairs = totals.where(F.col("cluster_id") % 3 == 0).select(
        "question", F.col("cluster_id").alias("cluster_a"), (F.col("cluster_id") + 1).alias("cluster_b")
    )
    return rubrics.resolve_contradictions(totals, pairs)


@query(
    "figures",
    r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\$?\d[\d,]*\.?\d*%?'),
  lambda s: rtrim(s, ',.')))) AS figures FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.array_sort(signals(F.col("text"))).alias("figures"))


@query(
    "invented_figures",
    _OR
    + r""", known AS (SELECT DISTINCT question, unnest(regexp_extract_all(fact, '\d+')) AS f FROM original),
  fresh AS (SELECT DISTINCT question, fact, unnest(list_distinct(regexp_extract_all(fact, '\d+'))) AS f FROM repaired)
  SELECT question, fact, count(*) AS new_figures FROM fresh r WHERE NOT EXISTS
    (SELECT 1 FROM known k WHERE k.question = r.question AND k.f = r.f) GROUP BY 1, 2""",
)
def _(t):
    return rubrics.invented_figures(t.original(), t.repaired())


_SHORT = """short AS (SELECT DISTINCT question, CASE WHEN pos % 3 = 0 THEN upper(split_part(fact, ' shipped', 1)) WHEN pos % 3 = 1 THEN fact || ' in total' ELSE fact END AS fact FROM repaired)"""


@query(
    "untraceable_facts",
    with_(ORIGINAL, REPAIRED, _SHORT)
    + """SELECT question, fact FROM short r WHERE NOT EXISTS (SELECT 1 FROM original o WHERE o.question = r.question
  AND (contains(lower(o.fact), lower(r.fact)) OR contains(lower(r.fact), lower(o.fact))))""",
)
def _(t):
    """Cut, extended and unchanged criteria against the facts they should come from."""
    p = F.col("pos") % 3
    fact = (
        F.when(p == 0, F.upper(F.substring_index("fact", " shipped", 1)))
        .when(p == 1, F.concat("fact", F.lit(" in total")))
        .otherwise(F.col("fact"))
    )
    return rubrics.untraceable(t.original(), t.repaired().withColumn("fact", fact))


_MOVES = """old AS (SELECT question, fact, max(CASE tier WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END) AS p FROM original GROUP BY 1, 2),
moves AS (SELECT r.question, r.fact, ['critical', 'important', 'optional'][CAST(p + 1 AS INT)] AS from_tier, r.tier AS to_tier
  FROM repaired r JOIN old USING (question, fact) WHERE r.tier <> ['critical', 'important', 'optional'][CAST(p + 1 AS INT)])"""


@query("tier_moves", with_(ORIGINAL, REPAIRED, _MOVES) + "SELECT * FROM moves")
def _(t):
    return rubrics.tier_moves(t.original(), t.repaired())


@query(
    "tier_churn",
    with_(ORIGINAL, REPAIRED, _MOVES)
    + """SELECT t.question, coalesce(m.n, 0) AS moved_count, t.n AS total_original, coalesce(m.n, 0) / t.n AS churn_rate
  FROM (SELECT question, count(*) AS n FROM original GROUP BY 1) t LEFT JOIN (SELECT question, count(*) AS n FROM moves GROUP BY 1) m USING (question)""",
)
def _(t):
    return rubrics.tier_churn(t.original(), t.repaired())


_ATTEMPTS = """attempts AS (SELECT l_orderkey AS question, CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 10000 + l_suppkey AS attempt,
  CASE WHEN l_discount >= 0.1 THEN 'failed' WHEN l_tax >= 0.08 THEN 'invented' WHEN l_tax <= 0.0 THEN 'unchecked' ELSE 'ok' END AS status,
  round(l_quantity / 60, 2) AS score FROM lineitem),
originals AS (SELECT o_orderkey AS question, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 600000, 2) END AS original_score FROM orders),
live AS (SELECT a.* FROM attempts a LEFT JOIN (SELECT question, min(attempt) AS stop FROM attempts WHERE status = 'failed' GROUP BY 1) f USING (question)
  WHERE f.stop IS NULL OR attempt <= f.stop),
cut AS (SELECT l.* FROM live l LEFT JOIN (SELECT question, min(attempt) AS stop FROM live WHERE status = 'ok' AND score >= 0.7 GROUP BY 1) s USING (question)
  WHERE s.stop IS NULL OR attempt <= s.stop),
best AS (SELECT question, max(attempt) AS used, max(score) FILTER (status = 'ok') AS best_score FROM cut GROUP BY 1),
which AS (SELECT c.question, min(c.attempt) AS best_attempt FROM cut c JOIN best b ON c.question = b.question AND c.score = b.best_score WHERE c.status = 'ok' GROUP BY 1)"""


@query(
    "best_attempt",
    with_(_ATTEMPTS)
    + """SELECT o.question, original_score, best_attempt, best_score, coalesce(used, 0) AS attempts_used,
  coalesce(best_score > coalesce(original_score, 0), false) AS repaired,
  CASE WHEN best_score > coalesce(original_score, 0) THEN best_score ELSE coalesce(original_score, 0) END AS final_score,
  CASE WHEN best_score IS NULL THEN 'reverted' WHEN best_score > coalesce(original_score, 0) THEN 'repaired' ELSE 'kept_original' END AS outcome
  FROM originals o LEFT JOIN best USING (question) LEFT JOIN which USING (question)""",
)
def _(t):
    """Line items of an order are its repair attempts."""
    attempts = t.lineitem.select(
        F.col("l_orderkey").alias("question"),
        (F.col("l_linenumber").cast("long") * 100_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("attempt"),
        F.when(F.col("l_discount") >= 0.1, "failed")
        .when(F.col("l_tax") >= 0.08, "invented")
        .when(F.col("l_tax") <= 0.0, "unchecked")
        .otherwise("ok")
        .alias("status"),
        F.round(F.col("l_quantity") / 60, 2).alias("score"),
    )
    originals = t.orders.select(
        F.col("o_orderkey").alias("question"),
        F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 600000, 2)).alias("original_score"),
    )
    return repair_round(originals, attempts)


@query(
    "routing_flags",
    _Q
    + """SELECT question, CASE WHEN nullif(recommendation, '') IS NOT NULL THEN recommendation = 'enrich'
    ELSE issue_count > 0 OR coalesce(overall, 0) < 0.7 END AS enrich,
  coalesce(recommendation = 'repair', false) AS repair, coalesce(recommendation = 'repair', false) AND coalesce(overall, 0) < 0.95 AS repair_not_good,
  NOT coalesce(recommendation IN ('stop', 'repair'), false) AS recheck,
  coalesce(recommendation = 'stop', false) AND coalesce(overall, 0) >= 0.7 AS carried FROM quality""",
)
def _(t):
    return t.quality().select(
        "question",
        rubrics.needs_enrichment().alias("enrich"),
        rubrics.needs_repair().alias("repair"),
        rubrics.needs_repair(skip_good=True).alias("repair_not_good"),
        rubrics.needs_check().alias("recheck"),
        rubrics.carried_over().alias("carried"),
    )


@query("quality_gate", _Q + "SELECT question, overall, coalesce(overall, 0) >= 0.7 AS passed FROM quality")
def _(t):
    return t.quality().select("question", "overall", rubrics.passes().alias("passed"))


@query(
    "repair_focus",
    _Q
    + """SELECT question, list_filter([CASE WHEN coalesce(specificity, 1) < 0.7 THEN 'specificity' END, CASE WHEN coalesce(atomicity, 1) < 0.7 THEN 'atomicity' END,
  CASE WHEN coalesce(tier_correctness, 1) < 0.7 THEN 'tier_correctness' END, CASE WHEN coalesce(coverage, 1) < 0.7 THEN 'coverage' END],
  lambda x: x IS NOT NULL) AS focus FROM quality""",
)
def _(t):
    return t.quality().select("question", rubrics.repair_focus().alias("focus"))


@query(
    "next_step",
    _Q
    + """SELECT question, CASE WHEN coverage < 0.9 THEN 'enrich' WHEN least(atomicity, coalesce(tier_correctness, 1)) < 0.8 THEN 'repair'
  WHEN coalesce(overall, 0) >= 0.95 THEN 'stop' WHEN issue_count > 0 AND coalesce(overall, 0) < 0.85 THEN 'repair' ELSE 'stop' END AS action FROM quality""",
)
def _(t):
    return t.quality().select("question", rubrics.next_step().alias("action"))


@query(
    "routing_counts",
    _Q
    + """, c AS (SELECT issue_count, count(*) FILTER (r = 'stop') AS n_stop, count(*) FILTER (r = 'enrich') AS n_enrich, count(*) FILTER (r = 'repair') AS n_repair,
    count(*) FILTER (r NOT IN ('stop', 'enrich', 'repair')) AS n_other FROM (SELECT *, coalesce(recommendation, '') AS r FROM quality) GROUP BY 1)
  SELECT *, n_enrich = 0 AS enrich_done, n_repair = 0 AS repair_done, n_enrich + n_repair + n_other = 0 AS all_stop FROM c""",
)
def _(t):
    return rubrics.action_counts(t.quality(), ["issue_count"])


@query(
    "pass_counts",
    _Q
    + """SELECT issue_count, count(*) FILTER (coalesce(overall, 0) >= 0.7) AS passed, count(*) AS total,
  count(*) FILTER (recommendation IN ('stop', 'repair')) AS carried_over FROM quality GROUP BY 1""",
)
def _(t):
    return rubrics.pass_counts(t.quality(), ["issue_count"])


@query(
    "quality_drift",
    _Q
    + """SELECT question, overall, round((specificity + atomicity + tier_correctness + coverage) / 4, 4) AS recomputed,
  abs(overall - (specificity + atomicity + tier_correctness + coverage) / 4) > 0.005 AS drifts FROM quality""",
)
def _(t):
    return rubrics.quality_drift(t.quality()).select("question", "overall", "recomputed", "drifts")


@query(
    "category_check",
    """SELECT c_mktsegment AS category, count(*) AS n, lower(trim(c_mktsegment)) IN
  ('quantitative', 'disclosure', 'governance', 'forensic', 'modeling', 'comparative') AS valid FROM
  (SELECT CASE c_custkey % 3 WHEN 0 THEN ' Governance ' WHEN 1 THEN 'forensic' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1""",
)
def _(t):
    n = F.col("c_custkey") % 3
    category = F.when(n == 0, " Governance ").when(n == 1, "forensic").otherwise(F.col("c_mktsegment"))
    return (
        t.customer.groupBy(category.alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("valid", rubrics.valid_category(F.col("category")))
    )


@query(
    "single_row_patch",
    "SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'patched' ELSE n_name END AS n_name, n_regionkey FROM nation",
)
def _(t):
    return rubrics.patch_one(t.nation, F.col("n_nationkey") == 7, "n_name", "patched")


@query(
    "facts_blocks",
    """SELECT doc_id AS question, 'Model: lines' || list_aggregate(list_concat([''], list_transform(string_split(text, chr(10)), lambda f: chr(10) || '  - ' || f)), 'string_agg', '')
  || chr(10) || chr(10) || 'Model: sentences' || list_aggregate(list_concat([''], list_transform(string_split(text, '. '), lambda f: chr(10) || '  - ' || f)), 'string_agg', '') || chr(10) AS facts_block FROM documents""",
)
def _(t):
    """Two answerers per document: one claims its lines, one its sentences."""
    both = F.array(
        F.struct(F.lit(0).alias("model_pos"), F.lit("lines").alias("model"), F.split("text", "\n").alias("facts")),
        F.struct(F.lit(1).alias("model_pos"), F.lit("sentences").alias("model"), F.split("text", r"\. ").alias("facts")),
    )
    return rubrics.facts_block(t.documents.select(F.col("doc_id").alias("question"), F.inline(both)))


@query(
    "gaps_blocks",
    with_(_NESTED)
    + """SELECT question, CASE WHEN len(important) + len(optional) = 0 THEN '(none)' ELSE
  list_aggregate(list_concat(list_transform(important, lambda s: 'Issue: ' || s), list_transform(optional, lambda s: 'Suggestion: ' || s)), 'string_agg', chr(10)) END AS gaps,
  CASE WHEN len(optional) = 0 THEN '(none)' ELSE list_aggregate(list_transform(optional, lambda s: '- ' || s), 'string_agg', chr(10)) END AS optional_block FROM nested""",
)
def _(t):
    return _nested(t).select(
        "question",
        rubrics.gaps_block(F.col("important"), F.col("optional")).alias("gaps"),
        rubrics.bullet_block(F.col("optional")).alias("optional_block"),
    )


_ENRICH = """records AS (SELECT c_custkey AS question, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'stop' WHEN 'BUILDING' THEN 'repair' WHEN 'MACHINERY' THEN '' ELSE 'enrich' END AS recommendation,
    CAST(c_nationkey % 2 AS INT) AS issue_count, 0.8::DOUBLE AS overall FROM customer),
  cand AS (SELECT o_custkey AS question, o_orderpriority AS model, year(o_orderdate) AS cluster_id, o_orderkey AS pos, 'in ' || year(o_orderdate) || ' ' || o_orderstatus AS fact FROM orders),
  rub AS (SELECT DISTINCT o_custkey AS question, 'in ' || year(o_orderdate) || ' ' || o_orderstatus AS fact FROM orders WHERE o_totalprice < 100000),
  fresh AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM rub r WHERE r.question = c.question AND r.fact = c.fact)),
  m AS (SELECT question, count(DISTINCT model) AS new_models FROM fresh GROUP BY 1),
  cl AS (SELECT question, cluster_id, count(DISTINCT model) AS n, max_by(fact, length(fact) * 10000000 - pos) AS fact FROM fresh GROUP BY 1, 2),
  s AS (SELECT question, count(DISTINCT fact) FILTER (n >= 2) AS added, count(*) FILTER (n >= 2) AS kept, count(*) FILTER (n < 2) AS below FROM cl GROUP BY 1),
  j AS (SELECT r.*, a.question IS NOT NULL AS has_answers, new_models, added, kept, below FROM records r
    LEFT JOIN (SELECT DISTINCT o_custkey AS question FROM orders) a USING (question) LEFT JOIN m USING (question) LEFT JOIN s USING (question)),
  st AS (SELECT *, CASE WHEN NOT (CASE WHEN recommendation <> '' THEN recommendation = 'enrich' ELSE issue_count > 0 OR overall < 0.7 END) THEN 'skipped'
    WHEN NOT has_answers THEN 'skipped_no_answers' WHEN new_models IS NULL THEN 'no_new_facts' WHEN new_models = 1 THEN 'manual_review_required'
    WHEN kept = 0 AND below > 0 THEN 'manual_review_required' WHEN kept = 0 THEN 'below_agreement' ELSE 'enriched' END AS status FROM j)"""


@query(
    "enrichment_status",
    with_(_ENRICH)
    + """SELECT question, status, CASE WHEN status = 'enriched' THEN added ELSE 0 END AS added_facts,
  CASE WHEN status = 'manual_review_required' THEN CASE WHEN new_models = 1 THEN 'gap_unresolved_single_model' ELSE 'gap_unresolved_below_agreement' END END AS flag_reason FROM st""",
)
def _(t):
    """Customers are records, their orders the newly extracted facts."""
    records, cand, rubric = _enriched(t)
    return rubrics.enrichment(records, cand.select("question", "model"), cand, rubric)


_ENRICH_ROWS = """, ties AS (SELECT c_custkey AS question, y AS cluster_a, y + 1 AS cluster_b FROM customer, range(1990, 2000) r(y) WHERE (c_custkey + y) % 3 = 0),
  firsts AS (SELECT question, cluster_id, min_by(fact, pos) AS first FROM fresh GROUP BY 1, 2),
  cl2 AS (SELECT cl.*, first, list_sort(list(DISTINCT model)) AS agreed_by FROM cl JOIN firsts USING (question, cluster_id) JOIN fresh f USING (question, cluster_id) GROUP BY ALL),
  met AS (SELECT t.*, a.n AS na, b.n AS nb, a.first AS fa, b.first AS fb FROM ties t JOIN cl2 a ON a.question = t.question AND a.cluster_id = cluster_a
    JOIN cl2 b ON b.question = t.question AND b.cluster_id = cluster_b),
  lost AS (SELECT question, cluster_a AS cluster_id FROM met WHERE na <= nb UNION SELECT question, cluster_b FROM met WHERE nb <= na),
  kept AS (SELECT * FROM cl2 WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.question = cl2.question AND l.cluster_id = cl2.cluster_id)),
  plus AS (SELECT question, fact, n, agreed_by, cluster_id FROM kept WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY question, fact ORDER BY cluster_id) = 1),
  counts AS (SELECT question, count(*) FILTER (n >= 2) AS plus, count(*) FILTER (n < 2) AS minus FROM kept GROUP BY 1),
  state AS (SELECT st.question, CASE WHEN st.status IN ('skipped', 'skipped_no_answers', 'no_new_facts') THEN st.status WHEN st.new_models = 1 THEN 'single'
    WHEN coalesce(plus, 0) = 0 AND coalesce(minus, 0) > 0 THEN 'gap' WHEN coalesce(plus, 0) = 0 THEN 'below_agreement' ELSE 'enriched' END AS s FROM st LEFT JOIN counts USING (question)),
  items AS (SELECT question, 'added' AS kind, row_number() OVER (PARTITION BY question ORDER BY cluster_id) AS place, fact AS text, array_to_string(agreed_by, ',') AS more, n::VARCHAR AS counts FROM plus JOIN state USING (question) WHERE s = 'enriched'
    UNION ALL SELECT question, 'contradiction_equal_agreement', row_number() OVER (PARTITION BY question ORDER BY cluster_a), fa || '|' || fb, NULL, na || ',' || nb FROM met JOIN state USING (question) WHERE na = nb AND s IN ('gap', 'below_agreement', 'enriched')
    UNION ALL SELECT question, 'gap_unresolved_single_model', 1, string_agg(fact, '|' ORDER BY pos), NULL, string_agg('1', ',') FROM fresh JOIN state USING (question) WHERE s = 'single' GROUP BY 1
    UNION ALL SELECT question, 'gap_unresolved_below_agreement', 1 + (SELECT count(*) FROM met m WHERE m.question = kept.question AND na = nb), string_agg(first, '|' ORDER BY cluster_id), NULL, string_agg(n, ',' ORDER BY cluster_id) FROM kept JOIN state USING (question) WHERE s = 'gap' AND n < 2 GROUP BY 1)
SELECT question, CASE WHEN s IN ('single', 'gap') THEN 'manual_review_required' ELSE s END AS status, kind, place::BIGINT AS place, text, more, counts FROM state LEFT JOIN items USING (question)"""


@query("enrichment_rows", with_(_ENRICH) + _ENRICH_ROWS)
def _(t):
    """Added facts and flags of every customer, one row each; clusters of following years contradict
    each other for some."""
    records, cand, rubric = _enriched(t)
    years = t.customer.select(F.col("c_custkey").alias("question"), F.explode(F.sequence(F.lit(1990), F.lit(1999))).alias("cluster_a"))
    ties = years.where((F.col("question") + F.col("cluster_a")) % 3 == 0).withColumn("cluster_b", F.col("cluster_a") + 1)
    rows = rubrics.enrichment_rows(records, cand.select("question", "model"), cand, rubric, ties)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    added = F.transform("added", lambda a, i: F.struct(F.lit("added").alias("kind"), (i + 1).cast("long").alias("place"), a["fact"].alias("text"), F.array_join(a["agreed_by"], ",").alias("more"), a["agreement_count"].cast("string").alias("counts")))
    none = F.lit(None).cast("string")
    flags = F.transform("flags", lambda f, i: F.struct(f["reason"].alias("kind"), (i + 1).cast("long").alias("place"), F.array_join(f["facts"], "|").alias("text"), none.alias("more"), joined(f["counts"]).alias("counts")))
    return rows.select("question", "status", F.inline_outer(F.concat(added, flags)))


def _enriched(t):
    seg = F.col("c_mktsegment")
    records = t.customer.select(
        F.col("c_custkey").alias("question"),
        F.when(seg == "AUTOMOBILE", "stop").when(seg == "BUILDING", "repair").when(seg == "MACHINERY", "").otherwise("enrich").alias("recommendation"),
        (F.col("c_nationkey") % 2).cast("int").alias("issue_count"),
        F.lit(0.8).alias("overall"),
    )
    fact = F.concat(F.lit("in "), F.year("o_orderdate").cast("string"), F.lit(" "), "o_orderstatus")
    cand = t.orders.select(
        F.col("o_custkey").alias("question"),
        F.col("o_orderpriority").alias("model"),
        F.year("o_orderdate").alias("cluster_id"),
        F.col("o_orderkey").alias("pos"),
        fact.alias("fact"),
    )
    rubric = t.orders.where(F.col("o_totalprice") < 100000).select(F.col("o_custkey").alias("question"), fact.alias("fact"))
    return records, cand, rubric


@query(
    "rubric_from_replies",
    """WITH l AS (SELECT l_orderkey AS question, 'Part ' || l_partkey AS fact, l_linenumber AS pos,
    CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'important' ELSE 'optional' END AS tier FROM lineitem),
  facts AS (SELECT question, fact, min(pos) AS pos FROM l GROUP BY 1, 2),
  kept AS (SELECT DISTINCT question, tier, fact FROM l WHERE tier <> 'optional')
  SELECT question, tier, fact FROM kept UNION ALL SELECT question, 'important', fact FROM facts f
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.question = f.question AND k.fact = f.fact)""",
)
def _(t):
    """Each line item's reply puts one fact into a tier; optional ones come back in an unknown
    tier, are dropped, and are appended as important."""
    from rubricon.catalog.base import tier_of

    tier = tier_of("l_returnflag")
    fact = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    name = F.when(tier == "optional", "minor").otherwise(F.initcap(tier))
    replies = spread(t.lineitem).select(
        F.col("l_orderkey").alias("question"),
        F.concat(F.lit('Sure: [{"tier": "'), name, F.lit('", "fact": "'), F.upper(fact), F.lit('"}] done')).alias("content"),
    )
    facts = t.lineitem.groupBy(F.col("l_orderkey").alias("question"), fact.alias("fact")).agg(F.min("l_linenumber").alias("pos"))
    return rubric_from_replies(replies, facts).select("question", "tier", "fact")


@query("developed_rubrics")
def _(t):
    """Customers' rubrics grown from their orders with rule-based stand-ins for the model steps.
    A customer has at most one fact per year and priority, which bounds a stand-in reply."""
    from rubricon.plans.develop import Steps, develop

    year = F.year("o_orderdate")
    fact = F.concat(F.lit("Spent in "), year.cast("string"), F.lit(" on "), "o_orderpriority")
    orders = t.orders.select(
        F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("model"), year.alias("cluster_id"), F.col("o_orderkey").alias("pos"), fact.alias("fact")
    )
    core = orders.where(F.col("model") == "F").groupBy("question", "fact").agg(F.min("pos").alias("pos")).select("question", "pos", "fact")

    def reply(rows, tier):
        item = F.struct(tier.alias("tier"), F.array("fact").alias("facts"))
        return rows.select("question", F.to_json(F.array(item)).alias("content"))

    def check(rubric):
        s = rubrics.flat_stats(rubric)
        share = lambda c: F.round(F.col(c) / F.col("total"), 4)
        return s.select(
            "question",
            F.lit(0.9).alias("specificity"),
            F.lit(0.9).alias("atomicity"),
            (F.lit(1.0) - share("n_critical") / 2).alias("tier_correctness"),
            F.least(F.lit(1.0), F.lit(0.5) + F.col("total") / 10).alias("coverage"),
            F.round(F.lit(1.0) - share("n_critical") / 2, 4).alias("overall"),
            F.lit(1).alias("issue_count"),
        )

    def repair(rubric, attempt):
        """Every attempt moves more criteria out of the top tier."""
        low = F.pmod(F.xxhash64("fact"), F.lit(4)) < attempt
        tier = F.when((F.col("tier") == "critical") & low, "important").otherwise(F.col("tier"))
        arrays = [F.collect_list(F.when(F.col("_t") == n, F.col("fact"))).alias(n) for n in ("critical", "important", "optional")]
        packed = rubric.withColumn("_t", tier).groupBy("question").agg(*arrays)
        return packed.select("question", F.to_json(F.struct("critical", "important", "optional")).alias("content"))

    steps = Steps(
        induce=lambda facts: reply(facts, F.when(F.pmod(F.xxhash64("fact"), F.lit(3)) > 0, "critical").otherwise("optional")),
        check=check,
        extract=lambda rubric: orders.join(rubric.select("question").distinct(), "question", "left_semi"),
        repair=repair,
    )
    return develop(core, steps, most=2, attempts=2)["stats"]

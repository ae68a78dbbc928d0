"""Queries over claims of several models."""

from pyspark.sql import functions as F

from rubricon.catalog.base import FACTS, query, with_
from rubricon.functions.facts import amount_in_millions, period
from rubricon.operators import consensus
from rubricon.plans.consolidate import consolidate

_AMOUNT = r"""amounts AS (SELECT *, regexp_extract(replace(fact, ',', ''), '(?i)\$?([\d]+\.?[\d]*)\s*(B|M|K|%)?', 1) AS num,
  upper(regexp_extract(replace(fact, ',', ''), '(?i)\$?([\d]+\.?[\d]*)\s*(B|M|K|%)?', 2)) AS unit,
  upper(regexp_extract(fact, '(?i)(FY\s*20\d\d|Q[1-4]\s*20\d\d|20\d\d)', 1)) AS p FROM facts),
valued AS (SELECT question, category, model, pos, fact,
  round_even(CASE WHEN num = '' THEN NULL WHEN unit = 'B' THEN num::DOUBLE * 1000 WHEN unit = 'K' THEN num::DOUBLE / 1000 ELSE num::DOUBLE END, 1) AS amount,
  CASE WHEN p = '' THEN 'UNKNOWN' ELSE replace(p, ' ', '') END AS period FROM amounts),
quant AS (SELECT *, CAST(round_even(amount / 5, 0) * 5 AS BIGINT) AS bucket FROM valued WHERE regexp_matches(fact, '\d'))"""
_CLUSTERS = """clusters AS (SELECT question, period, bucket, min(pos) AS first_pos, count(*) AS variants,
  list_sort(list(DISTINCT model)) AS agreed_by, arg_max(fact, length(fact) * 1000000000 - pos) AS fact,
  CAST(count(DISTINCT model) AS INT) AS agreement_count FROM quant GROUP BY 1, 2, 3)"""
_Q = with_(FACTS, _AMOUNT)
_C = with_(FACTS, _AMOUNT, _CLUSTERS)
_FAMILY = ["4-NOT SPECIFIED", "5-LOW"]


def _clusters(t):
    return consensus.clusters(consensus.bucketed(t.facts()), ["question", "period", "bucket"])


@query(
    "fact_types",
    with_(FACTS)
    + r"""SELECT question, model, CASE WHEN regexp_matches(fact, '\d') THEN 'quantitative' ELSE 'qualitative' END AS fact_type, count(*) AS facts
  FROM facts GROUP BY 1, 2, 3""",
)
def _(t):
    return consensus.by_type(t.facts()).groupBy("question", "model", "fact_type").agg(F.count(F.lit(1)).alias("facts"))


@query("fact_amounts", _Q + "SELECT pos, fact, amount, period FROM valued")
def _(t):
    f = F.col("fact")
    return t.facts().select("pos", "fact", amount_in_millions(f).alias("amount"), period(f).alias("period"))


@query("fact_buckets", _Q + "SELECT question, model, pos, period, amount, bucket FROM quant")
def _(t):
    return consensus.bucketed(t.facts()).select("question", "model", "pos", "period", "amount", "bucket")


@query("fact_clusters", _C + "SELECT * FROM clusters")
def _(t):
    return _clusters(t)


@query(
    "cluster_wordings",
    _C
    + """, wordings AS (SELECT question, period, bucket, 'About $' || bucket || 'M in ' || period AS wording FROM clusters WHERE first_pos % 2 = 0)
  SELECT question, period, bucket, CASE WHEN variants > 1 THEN coalesce(wording, fact) ELSE fact END AS fact
  FROM clusters LEFT JOIN wordings USING (question, period, bucket)""",
)
def _(t):
    """Supplied wordings exist for some clusters; the longest variant stands in elsewhere."""
    c = _clusters(t)
    wordings = c.where(F.col("first_pos") % 2 == 0).select(
        "question", "period", "bucket",
        F.concat(F.lit("About $"), F.col("bucket").cast("string"), F.lit("M in "), "period").alias("wording"),
    )
    return consensus.canonical(c, wordings, ["question", "period", "bucket"]).select("question", "period", "bucket", "fact")


@query(
    "agreement_marks",
    _C
    + """SELECT question, period, bucket, agreement_count, agreed_by = ['4-NOT SPECIFIED', '5-LOW'] AS family_only,
  agreement_count >= 2 AND agreed_by <> ['4-NOT SPECIFIED', '5-LOW'] AS core FROM clusters""",
)
def _(t):
    return consensus.agreement(_clusters(t), 2, _FAMILY).select(
        "question", "period", "bucket", "agreement_count", "family_only", "core"
    )


@query(
    "agreement_survivors",
    _C
    + """SELECT question, period, bucket, agreement_count, min_agreement FROM
  (SELECT *, CASE WHEN bucket % 10 = 0 THEN 3 END AS min_agreement FROM clusters) WHERE agreement_count >= coalesce(min_agreement, 2)""",
)
def _(t):
    rows = _clusters(t).withColumn("min_agreement", F.when(F.col("bucket") % 10 == 0, 3))
    return consensus.surviving(rows).select("question", "period", "bucket", "agreement_count", "min_agreement")


@query(
    "questions_without_core",
    _C
    + """, byp AS (SELECT question || '/' || period AS question, agreement_count FROM clusters)
  SELECT DISTINCT question, 'no facts reach the agreement threshold' AS error FROM byp
  WHERE question NOT IN (SELECT question FROM byp WHERE agreement_count >= 4)""",
)
def _(t):
    """Question and period together name a question here."""
    rows = _clusters(t).withColumn("question", F.concat_ws("/", "question", "period"))
    kept = consensus.surviving(rows.withColumn("min_agreement", F.lit(None).cast("int")), override=4)
    return consensus.without_core(rows.select("question").distinct(), kept)


@query(
    "question_totals",
    _C
    + """SELECT question, count(*) FILTER (core) AS core_count, count(*) FILTER (NOT core) AS discarded_count,
  count(*) FILTER (family_only) AS family_only_count FROM
  (SELECT question, agreed_by = ['4-NOT SPECIFIED', '5-LOW'] AS family_only,
   agreement_count >= 2 AND agreed_by <> ['4-NOT SPECIFIED', '5-LOW'] AS core FROM clusters) GROUP BY question""",
)
def _(t):
    return consensus.question_totals(consensus.agreement(_clusters(t), 2, _FAMILY))


@query(
    "model_alignment",
    with_(FACTS)
    + """SELECT model, count(DISTINCT question) AS questions, (SELECT count(DISTINCT question) FROM facts) AS all_questions,
  count(DISTINCT question) = (SELECT count(DISTINCT question) FROM facts) AS aligned FROM facts GROUP BY model""",
)
def _(t):
    return consensus.aligned(t.facts())




@query(
    "distinct_facts",
    """WITH raw AS (SELECT l_suppkey AS question, l_returnflag AS model, trim(fact) AS fact, min(pos) AS pos FROM
    (SELECT *, CASE WHEN l_quantity > 45 THEN '  ' ELSE ' ' || p_brand || ' ' || p_type || ' ' END AS fact,
      l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pos FROM lineitem JOIN part ON p_partkey = l_partkey)
    GROUP BY 1, 2, 3) SELECT question, model, fact, pos FROM raw WHERE fact <> ''""",
)
def _(t):
    fact = F.when(F.col("l_quantity") > 45, "  ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit(" ")))
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_suppkey").alias("question"),
        F.col("l_returnflag").alias("model"),
        fact.alias("fact"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"),
    )
    return consensus.distinct_facts(rows)


@query(
    "distinct_facts_any_case",
    """SELECT question, model, arg_min(fact, pos) AS fact, min(pos) AS pos FROM
  (SELECT n_name AS question, o_orderstatus AS model, o_orderkey AS pos,
    CASE WHEN o_orderkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS fact
   FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
  GROUP BY question, model, lower(fact)""",
)
def _(t):
    rows = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            F.col("n_name").alias("question"),
            F.col("o_orderstatus").alias("model"),
            F.col("o_orderkey").alias("pos"),
            F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("fact"),
        )
    )
    return consensus.distinct_facts(rows, ignore_case=True)


@query(
    "evidence_cleanup",
    r"""SELECT doc_id, list_transform(list_filter(list_transform(range(1, len(l) + 1), lambda i:
    {'fact': trim(regexp_replace(l[i], '[\t-\r ]+', ' ', 'g')), 'evidence': CASE WHEN i % 3 = 0 THEN '' ELSE trim(regexp_replace(source || '   ' || i, ' +', ' ', 'g')) END}),
    lambda p: p.fact <> '' AND p.evidence <> ''), lambda p: p.fact || ' <- ' || p.evidence) AS pairs
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)""",
)
def _(t):
    pairs = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(
            s.alias("fact"),
            F.when((i + 1) % 3 == 0, "").otherwise(F.concat("source", F.lit("   "), (i + 1).cast("string"))).alias("evidence"),
        ),
    )
    clean = consensus.clean_evidence(pairs)
    return t.documents.select(
        "doc_id", F.transform(clean, lambda p: F.concat(p["fact"], F.lit(" <- "), p["evidence"])).alias("pairs")
    )


@query(
    "merged_claims",
    with_(FACTS)
    + r""", steps AS (SELECT question, CAST(left(model, 1) AS INT) AS step, model, fact AS claim, fact || ' (' || model || ')' AS fact
    FROM facts WHERE NOT regexp_matches(fact, '\d') AND NOT (model = '3-MEDIUM' AND question = 'NATION_3'))
  SELECT question, claim, max_by(fact, step * 100000 ) AS fact, list_sort(list(DISTINCT model)) AS agreed_by,
  CAST(count(DISTINCT model) AS INT) AS agreement_count FROM (SELECT DISTINCT * FROM steps) GROUP BY 1, 2""",
)
def _(t):
    """Model-by-model merge of claims without figures; one model's reply failed once."""
    qual = consensus.by_type(t.facts()).where(F.col("fact_type") == "qualitative")
    steps = qual.select(
        "question",
        F.left("model", F.lit(1)).cast("int").alias("step"),
        "model",
        F.col("fact").alias("claim"),
        F.concat("fact", F.lit(" ("), "model", F.lit(")")).alias("fact"),
    )
    skipped = qual.where((F.col("model") == "3-MEDIUM") & (F.col("question") == "NATION_3")).select("question", "model").distinct()
    return consensus.merged_claims(steps, skipped)


@query(
    "consolidated_facts",
    _C
    + r""", qual AS (SELECT question, fact, list_sort(list(DISTINCT model)) AS agreed_by, count(DISTINCT model) AS n FROM facts
    WHERE NOT regexp_matches(fact, '\d') GROUP BY 1, 2),
  everything AS (SELECT question, fact, agreed_by, agreement_count, 'quantitative' AS fact_type FROM clusters
    UNION ALL SELECT question, fact, agreed_by, n, 'qualitative' FROM qual)
  SELECT question, fact, array_to_string(agreed_by, ',') AS agreed_by, CAST(agreement_count AS INT) AS agreement_count, fact_type
  FROM everything WHERE agreement_count >= 2 AND agreed_by <> ['4-NOT SPECIFIED', '5-LOW']""",
)
def _(t):
    """Core facts of both kinds: amounts by bucket, other claims by their text."""
    qual = consensus.by_type(t.facts()).where(F.col("fact_type") == "qualitative")
    steps = qual.select("question", F.lit(1).alias("step"), "model", F.col("fact").alias("claim"), "fact")
    core = consolidate(t.facts(), steps, family=_FAMILY)["core"]
    return core.select("question", "fact", F.array_join("agreed_by", ",").alias("agreed_by"), "agreement_count", "fact_type")

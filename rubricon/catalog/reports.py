"""Leaderboard, ranking and matching queries."""

from pyspark.sql import functions as F

from rubricon.catalog.base import SQL, SCORES, query, with_
from rubricon.operators import matching, reports
from rubricon.plans.report import report_tables

_SUMMARY = "avg(score) AS mean_score, median(score) AS median_score"


def _r(df, *cols):
    """Round measures for comparison."""
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "overall_leaderboard",
    with_(SCORES)
    + """SELECT model, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, min_score, max_score, n,
  CAST(row_number() OVER (ORDER BY mean_score DESC, model) AS INT) AS rank
  FROM (SELECT model, avg(score) AS mean_score, median(score) AS median_score, min(score) AS min_score,
    max(score) AS max_score, count(score) AS n FROM scores GROUP BY model)""",
)
def _(t):
    return _r(reports.leaderboard(t.scores()), "mean_score", "median_score")


def _grouped(g):
    agg = f"agg AS (SELECT {g}, model, {_SUMMARY}, count(score) AS count FROM scores WHERE {g} IS NOT NULL GROUP BY 1, 2)"
    base = with_(SCORES, agg)
    measures = "round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, count"
    over = f"(PARTITION BY {g} ORDER BY mean_score DESC"

    @query(
        f"{g}_scores",
        base + f"SELECT {g}, model, {measures}, CAST(dense_rank() OVER {over}) AS DOUBLE) AS rank_within_{g} FROM agg",
    )
    def _(t):
        out = reports.dense_ranks(reports.group_scores(t.scores(), g), g)
        return _r(out, "mean_score", "median_score")

    @query(
        f"{g}_rankings",
        base + f"SELECT {g}, model, {measures}, CAST(row_number() OVER {over}, model) AS INT) AS rank FROM agg",
    )
    def _(t):
        return _r(reports.row_ranks(reports.group_scores(t.scores(), g), g), "mean_score", "median_score")

    adv = f"adv AS (SELECT *, avg(mean_score) OVER (PARTITION BY {g}) AS {g}_average FROM agg)"

    @query(
        f"{g}_advantage",
        with_(SCORES, agg, adv)
        + f"SELECT {g}, model, {measures}, round({g}_average, 6) AS {g}_average, round(mean_score - {g}_average, 6) AS advantage FROM adv",
    )
    def _(t):
        out = reports.advantages(reports.group_scores(t.scores(), g), g)
        return _r(out, "mean_score", "median_score", f"{g}_average", "advantage")

    @query(
        f"{g}_specialists",
        with_(SCORES, agg, adv)
        + f"""SELECT {g}, model, {measures}, round({g}_average, 6) AS {g}_average, round(mean_score - {g}_average, 6) AS advantage
  FROM adv QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY mean_score - {g}_average DESC, model) = 1""",
    )
    def _(t):
        out = reports.specialists(reports.advantages(reports.group_scores(t.scores(), g), g), g)
        return _r(out, "mean_score", "median_score", f"{g}_average", "advantage")

    @query(
        f"{g}_winners",
        base
        + f"""SELECT {g}, model, {measures}, CAST(dense_rank() OVER {over}) AS DOUBLE) AS rank_within_{g} FROM agg
  QUALIFY row_number() OVER {over}, model) = 1""",
    )
    def _(t):
        ranked = reports.dense_ranks(reports.group_scores(t.scores(), g), g)
        return _r(reports.winners(ranked, g), "mean_score", "median_score")

    models = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cells = ", ".join(f"round(max(CASE WHEN model = '{m}' THEN mean_score END), 6) AS \"{m}\"" for m in models)

    @query(f"{g}_heatmap", base + f"SELECT {g}, {cells} FROM agg GROUP BY {g}")
    def _(t):
        return _r(reports.heatmap(reports.group_scores(t.scores(), g), g, t.models()), *t.models())

    ranks = ", ".join(f"CAST(max(CASE WHEN model = '{m}' THEN rank END) AS INT) AS \"{m}\"" for m in models)

    @query(
        f"{g}_rank_matrix",
        base + f"SELECT {g}, {ranks} FROM (SELECT *, row_number() OVER {over}, model) AS rank FROM agg) GROUP BY {g}",
    )
    def _(t):
        return reports.rank_matrix(reports.row_ranks(reports.group_scores(t.scores(), g), g), g, t.models())


for _g in ("domain", "workflow"):
    _grouped(_g)


# --- taxonomy joins ---------------------------------------------------------------
# Taxonomy: one row per part name and brand. Grades: one row per order with a part name
# as question text, so that names repeat on both sides.

_NAMES = """taxonomy AS (SELECT p_name || ' ' || p_brand AS question, p_partkey AS pos, p_type AS domain, p_brand AS workflow FROM part),
grades AS (SELECT o_orderpriority AS model, ' ' || p_name || ' ' || CASE WHEN o_orderstatus = 'F' THEN p_brand ELSE p_type END || ' ' AS question,
  o_orderkey AS pos, o_totalprice AS score FROM orders JOIN part ON p_partkey = o_custkey)"""


def _taxonomy(t):
    return t.part.select(
        F.concat("p_name", F.lit(" "), "p_brand").alias("question"),
        F.col("p_partkey").alias("pos"),
        F.col("p_type").alias("domain"),
        F.col("p_brand").alias("workflow"),
    )


def _grades(t):
    tail = F.when(F.col("o_orderstatus") == "F", F.col("p_brand")).otherwise(F.col("p_type"))
    return t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).select(
        F.col("o_orderpriority").alias("model"),
        F.concat(F.lit(" "), "p_name", F.lit(" "), tail, F.lit(" ")).alias("question"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_totalprice").alias("score"),
    )


_LAST = "last AS (SELECT model, trim(question) AS question, arg_max(score, pos) AS score FROM grades GROUP BY 1, 2)"


@query(
    "taxonomy_join",
    with_(_NAMES, _LAST)
    + """SELECT t.question, t.pos, t.domain, t.workflow, l.model, l.score
  FROM (SELECT trim(question) AS question, pos, domain, workflow FROM taxonomy) t JOIN last l USING (question)""",
)
def _(t):
    return matching.attach_taxonomy(_taxonomy(t), _grades(t))


@query(
    "coverage_audit",
    with_(
        _NAMES,
        "tq AS (SELECT DISTINCT trim(question) AS question FROM taxonomy)",
        "gq AS (SELECT DISTINCT model, trim(question) AS question FROM grades)",
        """sides AS (SELECT coalesce(a.model, g.model) AS model, coalesce(a.question, g.question) AS question,
      CASE WHEN a.question IS NULL THEN 'extra' WHEN g.question IS NULL THEN 'missing' ELSE 'matched' END AS kind
      FROM (SELECT * FROM tq CROSS JOIN (SELECT DISTINCT model FROM grades)) a
      FULL JOIN gq g ON a.model = g.model AND a.question = g.question)""",
    )
    + """SELECT model, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'missing') AS missing,
  count(*) FILTER (kind = 'extra') AS extra,
  array_to_string((list(question ORDER BY question) FILTER (kind = 'missing'))[1:5], ' | ') AS missing_examples,
  array_to_string((list(question ORDER BY question) FILTER (kind = 'extra'))[1:5], ' | ') AS extra_examples
  FROM sides GROUP BY model""",
)
def _(t):
    return matching.coverage_audit(_taxonomy(t), _grades(t))


_SETS = """sets AS (SELECT trim(question) AS question, 1 AS t, 0 AS g FROM taxonomy UNION ALL SELECT trim(question), 0, 1 FROM grades),
sides AS (SELECT question, max(t) AS t, max(g) AS g FROM sets GROUP BY 1)"""


@query(
    "question_sets",
    with_(_NAMES)
    + """SELECT 'common' AS side, question FROM (SELECT trim(question) AS question FROM taxonomy INTERSECT SELECT trim(question) FROM grades)
  UNION ALL SELECT 'taxonomy_only', question FROM (SELECT trim(question) AS question FROM taxonomy EXCEPT SELECT trim(question) FROM grades)
  UNION ALL SELECT 'grades_only', question FROM (SELECT trim(question) AS question FROM grades EXCEPT SELECT trim(question) FROM taxonomy)""",
)
def _(t):
    a = _taxonomy(t).select(F.trim("question").alias("question"))
    b = _grades(t).select(F.trim("question").alias("question"))
    side = lambda name, df: df.select(F.lit(name).alias("side"), "question")
    return (
        side("common", a.intersect(b))
        .unionByName(side("taxonomy_only", a.subtract(b)))
        .unionByName(side("grades_only", b.subtract(a)))
    )


@query(
    "model_rows_union",
    with_(SCORES)
    + "SELECT model, count(*) AS rows, round(sum(score), 2) AS total FROM scores GROUP BY model",
)
def _(t):
    """One frame per model, put together again and counted."""
    s = t.scores()
    out = None
    for m in t.models():
        part = s.where(F.col("model") == m)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 2).alias("total"))


_NORM = rf"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(nfc_normalize(text),
  '€', 'EUR'), '£', 'GBP'), '–', '-'), '—', '-'), '’', ''''), '‘', ''''), '“', '"'), '”', '"'), chr(160), ' '),
  '[\t-\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"""


@query("normalised_questions", f"SELECT doc_id, {_NORM} AS norm FROM documents")
def _(t):
    from rubricon.functions.text import normalise_question

    return t.documents.select("doc_id", normalise_question(F.col("text")).alias("norm"))


@query(
    "normalised_collapse",
    f"""SELECT count(*) AS questions, count(DISTINCT {_NORM}) AS distinct_questions,
  count(*) - count(DISTINCT {_NORM}) AS collapsed FROM documents""",
)
def _(t):
    return matching.collapse_check(t.documents.select(F.col("text").alias("question")))


@query(
    "exact_question_match",
    f"""WITH a AS (SELECT {_NORM} AS norm, arg_min(text, doc_id) AS taxonomy_question FROM documents GROUP BY 1),
  g AS (SELECT lang AS model, {_NORM} AS norm, arg_min(text, doc_id) AS grade_question FROM documents GROUP BY 1, 2)
  SELECT g.model, g.norm, g.grade_question, a.taxonomy_question FROM g JOIN a USING (norm)""",
)
def _(t):
    q = t.documents.select(F.col("lang").alias("model"), F.col("text").alias("question"), F.col("doc_id").alias("pos"))
    return matching.exact_match(matching.normalised(q.drop("model"), []), matching.normalised(q, ["model"]))


@query("numeric_tokens", r"SELECT doc_id, regexp_extract_all(text, '\d+(?:\.\d+)?') AS numbers FROM documents")
def _(t):
    from rubricon.functions.text import number_tokens

    return t.documents.select("doc_id", number_tokens(F.col("text")).alias("numbers"))


@query("fuzzy_question_match")
def _(t):
    """Customer-written question texts against the whole set of conversation turns: every
    turn is a taxonomy text, and its grade text lost its last character."""
    turns = t.conversations.select(
        F.col("role").alias("model"),
        F.concat_ws("-", "conv_id", "turn").alias("key"),
        "text",
    )
    from rubricon.functions.text import normalise_question

    norm = turns.select("model", normalise_question(F.col("text")).alias("norm")).distinct()
    grades = norm.select("model", F.expr("left(norm, length(norm) - 1)").alias("norm")).distinct()
    return matching.fuzzy_match(norm.select("norm").distinct(), grades).withColumn("ratio", F.round("ratio", 6))


@query("turn_similarity")
def _(t):
    """Similarity of every turn with the next one of its conversation."""
    from rubricon.functions.text import make_similarity

    turn = t.conversations.select("conv_id", "turn", "text")
    following = turn.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    pairs = turn.join(following, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(make_similarity()("text", "next_text"), 6).alias("ratio"))


@query("report_overview")
def _(t):
    """All report tables in one long frame."""
    tables = report_tables(t.scores(), t.models())
    out = None
    for name, df in sorted(tables.items()):
        part = df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


_REPORTS = ["overall_leaderboard"] + [f"{g}_{kind}" for g in ("domain", "workflow") for kind in ("scores", "rankings", "advantage", "specialists", "winners", "heatmap", "rank_matrix")]


@query("report_sizes", " UNION ALL ".join(f"SELECT '{name}' AS report, count(*) AS n_rows FROM ({SQL[name]})" for name in _REPORTS))
def _(t):
    """How many rows each report of one run has."""
    out = None
    for name, df in report_tables(t.scores(), t.models()).items():
        name = name.removeprefix("best_")
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out

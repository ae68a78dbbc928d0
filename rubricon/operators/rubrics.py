"""Rubrics: assembling, validating, repairing, de-duplicating and routing.

The flat form ``question, tier, pos, fact`` is used throughout; ``nested`` and ``flat``
convert to and from records with one array per tier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.text import fold_space, signals
from rubricon.operators.containment import FEW, contained
from rubricon.operators.grading import CATEGORIES, TIERS
from rubricon.operators.grouping import exploded, first_by, last_by, salted_join
from rubricon.session import stored

# Thresholds of the quality gate, of routing and of the shape warning.
QUALITY_THRESHOLD = 0.70
COVERAGE_LEAST, STRUCTURE_LEAST, STOP_OVERALL, OPEN_ISSUE_OVERALL = 0.90, 0.80, 0.95, 0.85
CRITICAL_SHARE = 0.8
DIMENSIONS = ["specificity", "atomicity", "tier_correctness", "coverage"]
ACTIONS = ["stop", "enrich", "repair"]


def tier_priority(tier: Column) -> Column:
    out = F.lit(len(TIERS) - 1)
    for i, name in enumerate(TIERS):
        out = F.when(tier == name, i).otherwise(out)
    return out


def tier_name(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), (priority + 1).cast("int"))


def flat(records: DataFrame) -> DataFrame:
    """One row per criterion from a record's three arrays."""

    def of_tier(t: str) -> Column:
        return F.transform(
            F.col(t), lambda f, i: F.struct(F.lit(t).alias("tier"), i.alias("pos"), f.alias("fact"))
        )

    items = F.flatten(F.array(*[of_tier(t) for t in TIERS]))
    return records.select("question", F.inline(items))


def stats(records: DataFrame) -> DataFrame:
    """Criterion counts per tier and in total, from the arrays of the record itself."""
    count = lambda t: F.coalesce(F.size(F.col(t)), F.lit(0))
    return records.select("question", *[count(t).alias(f"n_{t}") for t in TIERS]).withColumn(
        "total", sum((F.col(f"n_{t}") for t in TIERS[1:]), F.col(f"n_{TIERS[0]}"))
    )


def flat_stats(rubric: DataFrame) -> DataFrame:
    return rubric.groupBy("question").agg(
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS],
        F.count(F.lit(1)).alias("total"),
    )


def shape_warnings(counted: DataFrame) -> DataFrame:
    some = F.col("total") > 0
    return counted.withColumn(
        "mostly_critical", some & (F.col("n_critical") > CRITICAL_SHARE * F.col("total"))
    ).withColumn("no_optional", some & (F.col("n_optional") == 0))


def validation(rubric: DataFrame, facts: DataFrame) -> DataFrame:
    """Missing, unknown and repeated facts per question, with the first error text.

    Both sides meet in one aggregate, which holds counts only; a join would sort them as well. A fact
    or question that is NULL equals no other, so there it counts on either side.
    """
    assigned = rubric.select("question", "fact", F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_w"))
    wanted = facts.select("question", "fact", F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_w"))
    both = assigned.unionByName(wanted).groupBy("question", "fact").agg(F.sum("_n").alias("_n"), F.max("_w").alias("_w"))
    known = F.col("question").isNotNull() & F.col("fact").isNotNull()
    has = F.col("_n") > 0
    out = both.groupBy("question").agg(
        F.count_if(F.col("_w") & ~(known & has)).alias("missing"),
        F.count_if(has & ~(known & F.col("_w"))).alias("extra"),
        F.coalesce(F.sum(F.when(has, F.col("_n") - 1)), F.lit(0)).alias("duplicates"),
    )
    error = (
        F.when(F.col("missing") > 0, "omitted facts")
        .when(F.col("extra") > 0, "unknown facts")
        .when(F.col("duplicates") > 0, "duplicate facts")
    )
    return out.withColumn("error", error)


def repaired_assignment(rubric: DataFrame, facts: DataFrame) -> DataFrame:
    """Put an induced rubric back onto its source facts.

    A criterion equal to a fact up to case and spaces takes the fact's wording (the last
    fact of equal folded text), unknown criteria are dropped, repeats within a tier are
    dropped, and facts left out are appended to ``important`` in order.
    """
    fold = lambda c: fold_space(F.lower(c))
    originals = last_by(
        facts.select("question", fold(F.col("fact")).alias("_f"), F.col("pos").alias("_p"), F.col("fact").alias("_fact")),
        ["question", "_f"],
        ["_p", "_fact"],
    )
    # Copies of one criterion collapse before the join.
    induced = first_by(
        rubric.select("question", "tier", "pos", fold(F.col("fact")).alias("_f")), ["question", "tier", "_f"], ["pos"]
    )
    # A fact has one folded text, so these rows are distinct in question, tier and fact.
    kept = induced.join(originals, ["question", "_f"]).select("question", "tier", "pos", F.col("_fact").alias("fact"))
    left_out = (
        facts.select("question", "fact", "pos")
        .join(kept.select("question", "fact"), ["question", "fact"], "left_anti")
        .select("question", F.lit("important").alias("tier"), F.col("pos"), "fact")
    )
    return kept.withColumn("appended", F.lit(False)).unionByName(
        left_out.withColumn("appended", F.lit(True))
    )


def new_facts(candidates: DataFrame, rubric: DataFrame) -> DataFrame:
    """Candidate facts whose exact text is not in the rubric yet."""
    return candidates.join(rubric.select("question", "fact").distinct(), ["question", "fact"], "left_anti")


def lookup_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """First answer to the question inside each named answer file."""
    first = first_by(answers.select("answer_file", "question", "pos", "answer"), ["answer_file", "question"], ["pos"])
    return requests.join(first.drop("pos"), ["answer_file", "question"])


def cluster_tiers(clusters: DataFrame, rubric: DataFrame) -> DataFrame:
    """Highest tier of every cluster. ``clusters(question, cluster_id, pos, fact)``; a member
    that is not in the rubric counts as optional, and of a fact listed twice the later
    tier counts."""
    tiers = last_by(
        rubric.select("question", "fact", tier_priority(F.col("tier")).alias("_t"), "pos"),
        ["question", "fact"],
        ["_t", "pos"],
    ).drop("pos")
    joined = clusters.join(tiers, ["question", "fact"], "left")
    lowest = F.lit(len(TIERS) - 1)
    return joined.groupBy("question", "cluster_id").agg(
        tier_name(F.min(F.coalesce("_t", lowest))).alias("tier"),
        F.count(F.lit(1)).alias("members"),
        F.max_by("fact", F.struct(F.length("fact"), -F.col("pos"))).alias("fact"),
    )


def resolve_contradictions(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop the less supported cluster of every contradicting pair; equal support flags both.

    ``clusters(question, cluster_id, agreement_count)``, ``pairs(question, cluster_a, cluster_b)``.
    """
    side = lambda s: clusters.select(
        "question", F.col("cluster_id").alias(f"cluster_{s}"), F.col("agreement_count").alias(f"n_{s}")
    )
    judged = pairs.join(side("a"), ["question", "cluster_a"]).join(side("b"), ["question", "cluster_b"])
    tie = F.col("n_a") == F.col("n_b")
    losers = F.when(tie, F.array("cluster_a", "cluster_b")).otherwise(
        F.array(F.when(F.col("n_a") < F.col("n_b"), F.col("cluster_a")).otherwise(F.col("cluster_b")))
    )
    out = (
        judged.select("question", F.explode(losers).alias("cluster_id"), tie.alias("tie"))
        .groupBy("question", "cluster_id")
        .agg(F.max("tie").alias("flagged"))
    )
    return clusters.join(out, ["question", "cluster_id"], "left").withColumn(
        "outcome",
        F.when(F.col("flagged").isNull(), "kept").when(F.col("flagged"), "review").otherwise("dropped"),
    ).drop("flagged")


def invented_figures(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Repaired facts with a figure that occurs nowhere in the original rubric of the question."""
    known = exploded(original, ["question"], signals(F.col("fact")), "_i", "figure").drop("_i").distinct()
    facts = repaired.select("question", "fact").distinct()
    return (
        exploded(facts, ["question", "fact"], signals(F.col("fact")), "_i", "figure")
        .join(known, ["question", "figure"], "left_anti")
        .groupBy("question", "fact")
        .agg(F.count(F.lit(1)).alias("new_figures"))
    )


def untraceable(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Repaired facts that neither equal, contain nor are contained in an original fact.

    Where a question has up to ``FEW`` original facts these become one row, which its repaired facts
    are compared with, so both sides are moved once. For the other questions containment is found by
    equi-join on grams instead of comparing all pairs of a question.
    """
    o = original.select("question", F.lower("fact").alias("text")).where("question is not null")
    r = repaired.select("question", "fact")
    sizes = o.groupBy("question").agg(F.count(F.lit(1)).alias("_n"))
    large = stored(sizes.where(F.col("_n") > FEW).select("question"), "large-questions")
    # Dealt first: rows of a question seldom lie together, so a set of each part would save nothing.
    sets = o.join(large, "question", "left_anti").repartition("question").groupBy("question").agg(F.collect_set("text").alias("_o"))
    text = F.lower("fact")
    same = lambda x: (x == text) | ((text != "") & F.contains(x, text)) | ((x != "") & F.contains(text, x))
    traced = F.coalesce(F.exists("_o", same), F.lit(False))
    small = r.join(large, "question", "left_anti").join(sets, "question", "left").where(~traced).select("question", "fact").distinct()
    if large.isEmpty():
        return small
    of_large = lambda df: df.join(large, "question", "left_semi")
    return small.unionByName(_untraceable_by_grams(of_large(o).distinct(), of_large(r)))


def _untraceable_by_grams(o: DataFrame, repaired: DataFrame) -> DataFrame:
    r = repaired.select("question", "fact", F.lower("fact").alias("text")).distinct()
    open_r = stored(r.join(o, ["question", "text"], "left_anti"), "untraced")
    texts = open_r.select("question", "text").distinct()
    o = o.join(texts.select("question").distinct(), "question", "left_semi")
    as_ = lambda df, name: df.withColumnRenamed("text", name)
    inside = contained(as_(texts, "needle"), as_(o, "haystack"), ["question"]).select("question", F.col("needle").alias("text"))
    around = contained(as_(o, "needle"), as_(texts, "haystack"), ["question"]).select("question", F.col("haystack").alias("text"))
    traced = inside.unionByName(around).distinct()
    return open_r.join(traced, ["question", "text"], "left_anti").select("question", "fact")


def tier_moves(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Facts whose tier differs between two versions. A fact listed twice in the original
    counts with its later tier."""
    old = last_by(
        original.select("question", "fact", tier_priority(F.col("tier")).alias("_t"), "pos"),
        ["question", "fact"],
        ["_t", "pos"],
    ).select("question", "fact", tier_name(F.col("_t")).alias("from_tier"))
    return (
        repaired.select("question", "fact", F.col("tier").alias("to_tier"))
        .join(old, ["question", "fact"])
        .where(F.col("from_tier") != F.col("to_tier"))
    )


def tier_churn(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Moved facts, original size and their ratio per question."""
    moved = tier_moves(original, repaired).groupBy("question").agg(F.count(F.lit(1)).alias("moved_count"))
    total = original.groupBy("question").agg(F.count(F.lit(1)).alias("total_original"))
    return total.join(moved, "question", "left").select(
        "question",
        F.coalesce("moved_count", F.lit(0)).alias("moved_count"),
        "total_original",
        (F.coalesce("moved_count", F.lit(0)) / F.col("total_original")).alias("churn_rate"),
    )


def best_attempt(originals: DataFrame, attempts: DataFrame, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """Outcome of bounded repair attempts.

    ``attempts(question, attempt, status, score)`` with status ``ok``, ``invented`` (figures
    not in the original), ``unchecked`` (no quality score) or ``failed`` (no repair; ends
    the attempts); ``attempt`` is unique within a question. Attempts end at the first score that reaches the threshold. The best
    score counts, the earliest on ties, and only if it beats the original. Everything
    is one aggregate per question because an attempt that reaches the threshold beats
    all before it.
    """
    ended = attempts.where(F.col("status") == "failed").groupBy("question").agg(F.min("attempt").alias("_end"))
    ok = F.col("status") == "ok"
    live = salted_join(attempts, ended, ["question"], ["attempt"], "left").where(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end")))
    passed = ok & (F.col("score") >= threshold)
    agg = live.groupBy("question").agg(
        F.min(F.when(passed, F.col("attempt"))).alias("_stop"),
        F.min_by(F.struct("attempt", "score"), F.when(passed, F.col("attempt"))).alias("_pass"),
        F.max_by(F.struct("attempt", "score"), F.when(ok, F.struct("score", -F.col("attempt")))).alias("_best"),
        F.max("attempt").alias("_last"),
    )
    best = F.coalesce("_pass", "_best")
    out = originals.join(agg, "question", "left").select(
        *originals.columns,
        best["attempt"].alias("best_attempt"),
        best["score"].alias("best_score"),
        F.coalesce("_stop", "_last", F.lit(0)).alias("attempts_used"),
    )
    improved = F.coalesce(F.col("best_score") > F.coalesce("original_score", F.lit(0.0)), F.lit(False))
    return (
        out.withColumn("repaired", improved)
        .withColumn("final_score", F.when(improved, F.col("best_score")).otherwise(F.coalesce("original_score", F.lit(0.0))))
        .withColumn(
            "outcome",
            F.when(F.col("best_score").isNull(), "reverted").when(improved, "repaired").otherwise("kept_original"),
        )
    )


# --- routing ------------------------------------------------------------------------


def needs_enrichment() -> Column:
    """The recommendation decides; without one, open issues or a low overall score do."""
    stored = F.nullif(F.col("recommendation"), F.lit(""))
    fallback = (F.coalesce("issue_count", F.lit(0)) > 0) | (
        F.coalesce("overall", F.lit(0.0)) < QUALITY_THRESHOLD
    )
    return F.when(stored.isNotNull(), stored == "enrich").otherwise(fallback)


def needs_repair(skip_good: bool = False) -> Column:
    flagged = F.coalesce(F.col("recommendation") == "repair", F.lit(False))
    if not skip_good:
        return flagged
    return flagged & (F.coalesce("overall", F.lit(0.0)) < STOP_OVERALL)


def needs_check() -> Column:
    """Records to check again and to de-duplicate: neither stopped nor waiting for repair."""
    return ~F.coalesce(F.col("recommendation").isin("stop", "repair"), F.lit(False))


def carried_over(threshold: float = QUALITY_THRESHOLD) -> Column:
    """Older rule: only stopped records at the threshold skip the check."""
    return F.coalesce(F.col("recommendation") == "stop", F.lit(False)) & passes(threshold)


def passes(threshold: float = QUALITY_THRESHOLD) -> Column:
    return F.coalesce("overall", F.lit(0.0)) >= threshold


def repair_focus(threshold: float = QUALITY_THRESHOLD) -> Column:
    """Dimensions below the threshold; a missing score passes."""
    dims = F.array(*[F.struct(F.lit(d).alias("name"), F.col(d).alias("score")) for d in DIMENSIONS])
    low = F.filter(dims, lambda x: F.coalesce(x["score"], F.lit(1.0)) < threshold)
    return F.transform(low, lambda x: x["name"])


def next_step() -> Column:
    """Rule form of the routing decision, in order of priority."""
    issues = F.coalesce("issue_count", F.lit(0)) > 0
    structure = F.least(F.coalesce("atomicity", F.lit(1.0)), F.coalesce("tier_correctness", F.lit(1.0)))
    return (
        F.when(F.coalesce("coverage", F.lit(0.0)) < COVERAGE_LEAST, "enrich")
        .when(structure < STRUCTURE_LEAST, "repair")
        .when(F.coalesce("overall", F.lit(0.0)) >= STOP_OVERALL, "stop")
        .when(issues & (F.coalesce("overall", F.lit(0.0)) < OPEN_ISSUE_OVERALL), "repair")
        .otherwise("stop")
    )


def action_counts(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per action and whether the enrich and repair loops are done."""
    action = F.lower(F.trim(F.coalesce("recommendation", F.lit(""))))
    out = records.groupBy(*by).agg(
        *[F.count_if(action == a).alias(f"n_{a}") for a in ACTIONS],
        F.count_if(~action.isin(ACTIONS)).alias("n_other"),
    )
    return (
        out.withColumn("enrich_done", F.col("n_enrich") == 0)
        .withColumn("repair_done", F.col("n_repair") == 0)
        .withColumn("all_stop", (F.col("n_enrich") + F.col("n_repair") + F.col("n_other")) == 0)
    )


def pass_counts(records: DataFrame, by: Sequence[str] = (), threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count_if(passes(threshold)).alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~needs_check()).alias("carried_over"),
    )


def quality_drift(records: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Overall recomputed as the mean of the four scores, and whether the reported one differs."""
    mean = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) / len(DIMENSIONS)
    return records.withColumn("recomputed", F.round(mean, 4)).withColumn(
        "drifts", F.abs(F.col("overall") - mean) > tolerance
    )


def valid_category(category: Column) -> Column:
    return F.coalesce(F.lower(F.trim(category)).isin(CATEGORIES), F.lit(False))


# --- text blocks ---------------------------------------------------------------------


def facts_block(records: DataFrame) -> DataFrame:
    """Per question the models and their facts as text. One row per question and model."""
    lines = F.concat(
        F.lit("Model: "),
        F.col("model"),
        F.array_join(F.transform("facts", lambda f: F.concat(F.lit("\n  - "), f)), ""),
        F.lit("\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("model_pos", lines.alias("text"))))
    return records.groupBy("question").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("facts_block")
    )


def gaps_block(issues: Column, suggestions: Column) -> Column:
    mark = lambda items, label: F.transform(items, lambda i: F.concat(F.lit(label), i))
    lines = F.concat(mark(issues, "Issue: "), mark(suggestions, "Suggestion: "))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(none)"))


def bullet_block(items: Column) -> Column:
    lines = F.transform(items, lambda i: F.concat(F.lit("- "), i))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(none)"))


# --- enrichment ----------------------------------------------------------------------


def enrichment_rows(
    records: DataFrame, answers: DataFrame, candidates: DataFrame, rubric: DataFrame, contradictions: DataFrame | None = None, min_agreement: int = 2
) -> DataFrame:
    """Outcome of an enrichment round per record: ``question, status, added, flags``.

    ``records(question, recommendation, issue_count, overall)``, ``answers(question, model)``,
    ``candidates(question, model, cluster_id, pos, fact)``, ``rubric(question, tier, pos, fact)`` and
    ``contradictions(question, cluster_a, cluster_b)``. ``added`` lists (fact, agreed_by, agreement_count)
    in order of cluster; ``flags`` lists (reason, facts, counts) for a person to decide: contradicting
    clusters of equal support first, then what left a gap open. The less supported of two contradicting
    clusters goes without a flag.
    """
    fresh = new_facts(candidates, rubric)
    models = fresh.groupBy("question").agg(F.count_distinct("model").alias("new_models"))
    clusters = fresh.groupBy("question", "cluster_id").agg(
        F.array_sort(F.collect_set("model")).alias("agreed_by"),
        F.min_by("fact", F.struct("pos", "model")).alias("first"),
        F.max_by("fact", F.struct(F.length("fact"), -F.col("pos"))).alias("fact"),
    ).withColumn("agreement_count", F.size("agreed_by").cast("long"))
    count = F.col("agreement_count")
    if contradictions is None:
        open_, ties = clusters, None
    else:
        judged = resolve_contradictions(clusters.select("question", "cluster_id", "agreement_count"), contradictions)
        open_ = clusters.join(judged.where("outcome = 'kept'").select("question", "cluster_id"), ["question", "cluster_id"])
        side = lambda s: clusters.select("question", F.col("cluster_id").alias(f"cluster_{s}"), F.struct(F.col("first").alias("fact"), count.alias("n")).alias(s))
        pairs = contradictions.join(side("a"), ["question", "cluster_a"]).join(side("b"), ["question", "cluster_b"]).where("a.n = b.n")
        tie = F.struct("cluster_a", "cluster_b", F.array("a.fact", "b.fact").alias("facts"), F.array("a.n", "b.n").alias("counts"))
        ties = pairs.groupBy("question").agg(F.array_sort(F.collect_list(tie)).alias("_ties"))
    enough = count >= min_agreement
    # A wording that two clusters share is added once, with the first of them.
    nth = F.row_number().over(Window.partitionBy("question", "fact", enough).orderBy("cluster_id"))
    listed = open_.withColumn("_new", enough & (nth == 1)).groupBy("question").agg(
        F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("cluster_id", "fact", "agreed_by", "agreement_count")))).alias("_added"),
        F.array_sort(F.collect_list(F.when(~enough, F.struct("cluster_id", "first", "agreement_count")))).alias("_below"),
    )
    lone = fresh.join(models.where("new_models = 1").select("question"), "question", "left_semi").groupBy("question")
    lone = lone.agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("_lone"))
    read = answers.select("question").distinct().withColumn("_answers", F.lit(True))
    joined = records.join(read, "question", "left").join(models, "question", "left").join(listed, "question", "left").join(lone, "question", "left")
    joined = joined.join(ties, "question", "left") if ties is not None else joined.withColumn("_ties", F.lit(None).cast("array<struct<facts:array<string>,counts:array<bigint>>>"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    single = (F.col("new_models") == 1) & F.lit(min_agreement > 1)
    gap = none("_added") & ~none("_below")
    status = (
        F.when(~needs_enrichment(), "skipped")
        .when(F.col("_answers").isNull(), "skipped_no_answers")
        .when(F.col("new_models").isNull(), "no_new_facts")
        .when(single | gap, "manual_review_required")
        .when(none("_added"), "below_agreement")
        .otherwise("enriched")
    )
    out = joined.withColumn("status", status)
    flag = lambda reason, facts, counts: F.struct(F.lit(reason).alias("reason"), facts.alias("facts"), counts.alias("counts"))
    of = lambda c, field: F.transform(c, lambda x: x[field])
    ones = F.transform("_lone", lambda x: F.lit(1).cast("long"))
    flags_type = "array<struct<reason:string,facts:array<string>,counts:array<bigint>>>"
    empty = F.array().cast(flags_type)
    equal = F.coalesce(F.transform("_ties", lambda x: flag("contradiction_equal_agreement", x["facts"], x["counts"])), empty)
    below = F.when(F.col("status") == "manual_review_required", F.array(flag("gap_unresolved_below_agreement", of("_below", "first"), of("_below", "agreement_count"))))
    flags = (
        F.when(F.col("status").isin("skipped", "skipped_no_answers", "no_new_facts"), empty)
        .when(single, F.array(flag("gap_unresolved_single_model", of("_lone", "fact"), ones)))
        .otherwise(F.concat(equal, F.coalesce(below, empty)))
    )
    added = F.transform("_added", lambda x: F.struct(x["fact"].alias("fact"), x["agreed_by"].alias("agreed_by"), x["agreement_count"].alias("agreement_count")))
    added = F.when(F.col("status") == "enriched", added).otherwise(F.array().cast("array<struct<fact:string,agreed_by:array<string>,agreement_count:bigint>>"))
    return out.select("question", "status", added.alias("added"), flags.cast(flags_type).alias("flags"))


def enrichment(
    records: DataFrame, answers: DataFrame, candidates: DataFrame, rubric: DataFrame, min_agreement: int = 2
) -> DataFrame:
    """Status of an enrichment round per record, with the number of added facts and the reason why a
    person has to look at it. Takes what ``enrichment_rows`` does."""
    rows = enrichment_rows(records, answers, candidates, rubric, min_agreement=min_agreement)
    review = F.col("status") == "manual_review_required"
    reason = F.when(review, F.element_at("flags", -1)["reason"])
    return rows.select("question", "status", F.size("added").cast("long").alias("added_facts"), reason.alias("flag_reason"))


def patch_one(df: DataFrame, match: Column, column: str, value: str) -> DataFrame:
    """Replace one cell; anything but exactly one matching row is an error."""
    hits = df.where(match).limit(2).count()
    if hits != 1:
        raise ValueError(f"expected exactly one matching row, found {'none' if hits == 0 else 'several'}")
    return df.withColumn(column, F.when(match, F.lit(value)).otherwise(F.col(column)))

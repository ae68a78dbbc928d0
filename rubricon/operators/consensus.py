"""Consensus facts: equal claims of several models, grouped and counted.

``facts`` holds ``question, category, model, pos, fact``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.functions.facts import amount_bucket, amount_in_millions, is_quantitative, period
from rubricon.functions.text import fold_space, trim_space
from rubricon.operators.grouping import first_by

MIN_AGREEMENT = 2


def fact_rows(records: DataFrame) -> DataFrame:
    """Flat twin of per-model records with a ``facts`` array."""
    keep = [c for c in records.columns if c != "facts"]
    return records.select(*keep, F.posexplode("facts").alias("pos", "fact"))


def distinct_facts(facts: DataFrame, ignore_case: bool = False) -> DataFrame:
    """First occurrence of a stripped, non-empty fact per question and model."""
    rows = facts.withColumn("fact", trim_space(F.col("fact"))).where(F.col("fact") != "")
    rows = rows.withColumn("_key", F.lower("fact") if ignore_case else F.col("fact"))
    return first_by(rows, ["question", "model", "_key"], ["pos"]).drop("_key")


def clean_evidence(pairs: Column) -> Column:
    """``array<struct<fact, evidence>>`` with whitespace folded and incomplete pairs dropped."""
    folded = F.transform(
        pairs, lambda p: F.struct(fold_space(p["fact"]).alias("fact"), fold_space(p["evidence"]).alias("evidence"))
    )
    return F.filter(folded, lambda p: (p["fact"] != "") & (p["evidence"] != ""))


def by_type(facts: DataFrame) -> DataFrame:
    return facts.withColumn(
        "fact_type", F.when(is_quantitative(F.col("fact")), "quantitative").otherwise("qualitative")
    )


def bucketed(facts: DataFrame) -> DataFrame:
    """Quantitative facts with period, amount and amount bucket. Facts of one question with
    equal period and bucket form one cluster."""
    amount = amount_in_millions(F.col("fact"))
    return (
        facts.where(is_quantitative(F.col("fact")))
        .withColumn("period", period(F.col("fact")))
        .withColumn("amount", amount)
        .withColumn("bucket", amount_bucket(F.col("amount")))
    )


def clusters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supporters and default wording per cluster. The member list is not gathered; the set
    of models is bounded by the number of models, and the wording is the longest variant,
    the first of equal length."""
    return rows.groupBy(*keys).agg(
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("variants"),
        F.array_sort(F.collect_set("model")).alias("agreed_by"),
        F.max_by("fact", F.struct(F.length("fact"), -F.col("pos"))).alias("fact"),
    ).withColumn("agreement_count", F.size("agreed_by"))


def canonical(clustered: DataFrame, wordings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Use the supplied wording of a multi-member cluster where there is one."""
    new = wordings.select(*keys, F.col("wording"))
    return clustered.join(new, list(keys), "left").withColumn(
        "fact", F.when(F.col("variants") > 1, F.coalesce("wording", "fact")).otherwise(F.col("fact"))
    ).drop("wording")


def single_family(agreed_by: Column, family: Sequence[str]) -> Column:
    """True when the supporters are exactly the models of one family."""
    return agreed_by == F.array(*[F.lit(m) for m in sorted(family)])


def agreement(
    clustered: DataFrame, min_agreement: int = MIN_AGREEMENT, family: Sequence[str] = ()
) -> DataFrame:
    """Mark core and family-only facts."""
    alone = single_family(F.col("agreed_by"), family) if family else F.lit(False)
    return clustered.withColumn("family_only", alone).withColumn(
        "core", (F.col("agreement_count") >= min_agreement) & ~F.col("family_only")
    )


def surviving(facts: DataFrame, override: int | None = None) -> DataFrame:
    """Facts that reach the agreement threshold: an override, else the record's own value,
    else the default."""
    least = F.coalesce(F.lit(override).cast("int"), F.col("min_agreement"), F.lit(MIN_AGREEMENT))
    return facts.where(F.col("agreement_count") >= least)


def without_core(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """Questions that lose every fact, as error rows."""
    return questions.join(kept.select("question").distinct(), "question", "left_anti").withColumn(
        "error", F.lit("no facts reach the agreement threshold")
    )


def question_totals(marked: DataFrame) -> DataFrame:
    """Core, discarded and family-only counts per question."""
    return marked.groupBy("question").agg(
        F.count_if("core").alias("core_count"),
        F.count_if(~F.col("core")).alias("discarded_count"),
        F.count_if("family_only").alias("family_only_count"),
    )


def aligned(facts: DataFrame) -> DataFrame:
    """Questions per model against the whole set; a model that misses questions is named
    instead of being mixed up by position."""
    per = facts.groupBy("model").agg(F.countDistinct("question").alias("questions"))
    total = facts.agg(F.countDistinct("question")).scalar()
    return per.withColumn("all_questions", total).withColumn(
        "aligned", F.col("questions") == F.col("all_questions")
    )


def merged_claims(steps: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Supporters of qualitative claims after a model-by-model merge.

    ``steps`` holds ``question, step, model, claim, fact``: the claim each new fact was
    merged into, one step per model. Steps whose reply failed are ``skipped`` by
    ``(question, model)`` and leave the list unchanged. The wording of a claim is that
    of its latest step.
    """
    rows = steps if skipped is None else steps.join(skipped, ["question", "model"], "left_anti")
    return rows.groupBy("question", "claim").agg(
        F.max_by("fact", F.struct("step", "fact")).alias("fact"),
        F.array_sort(F.collect_set("model")).alias("agreed_by"),
        F.count_distinct("model").cast("int").alias("agreement_count"),
    )

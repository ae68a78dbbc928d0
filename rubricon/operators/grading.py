"""Scores from criterion verdicts.

``verdicts`` holds one row per criterion: ``model, question, tier, pos, fact, met, reason``.
``weights`` holds ``category, critical, important, optional, hallucination``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tiers from high to low, and points per category and tier.
TIERS = ["critical", "important", "optional"]
WEIGHTS = [
    ("quantitative", 12.0, 6.0, 2.0, -10.0),
    ("disclosure", 10.0, 5.0, 2.0, -6.0),
    ("governance", 10.0, 5.0, 2.0, -6.0),
    ("forensic", 10.0, 5.0, 2.0, -8.0),
    ("modeling", 10.0, 5.0, 2.0, -8.0),
    ("comparative", 10.0, 5.0, 2.0, -6.0),
]
CATEGORIES = [w[0] for w in WEIGHTS]
ANSWER_FIELDS = ["answer", "model_answer", "response", "output"]


def weight_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        WEIGHTS,
        "category string, critical double, important double, optional double, hallucination double",
    )


def weight_map(category: Column) -> Column:
    """Six-row weight table as a literal map: the lookup needs no join. NULL when unknown."""
    entries = []
    for name, critical, important, optional, hallucination in WEIGHTS:
        entries += [
            F.lit(name),
            F.struct(
                F.lit(critical).alias("critical"),
                F.lit(important).alias("important"),
                F.lit(optional).alias("optional"),
                F.lit(hallucination).alias("hallucination"),
            ),
        ]
    return F.try_element_at(F.create_map(*entries), category)


def with_weights(df: DataFrame, out: str = "weights") -> DataFrame:
    return df.withColumn(out, weight_map(F.col("category")))


def answer_text(df: DataFrame) -> Column:
    """First non-empty answer field, else empty text."""
    fields = [F.nullif(F.col(c), F.lit("")) for c in ANSWER_FIELDS if c in df.columns]
    return F.coalesce(*fields, F.lit(""))


def answer_rows(runs: DataFrame) -> DataFrame:
    """Question and answer rows: the final answer only on success, else the error."""
    return runs.select(
        "model",
        "question",
        "success",
        F.when(F.col("success"), F.col("final_answer")).alias("answer"),
        F.coalesce("error", "final_error").alias("error"),
    )


def answered(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("success") & F.coalesce(F.col("answer") != "", F.lit(False)))


def pair_with_answers(rubrics: DataFrame, answers: DataFrame, on: str = "question") -> DataFrame:
    """Rubrics with their answers by question or by position; unequal counts are an error."""
    counts = [df.select(F.count(F.lit(1)).alias("n")).first()["n"] for df in (rubrics, answers)]
    if counts[0] != counts[1]:
        raise ValueError(f"rubric count {counts[0]} != answer count {counts[1]}")
    return rubrics.join(answers, on)


def attach_verdicts(criteria: DataFrame, replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Criteria with judge results. A failed or missing reply is unmet with a reason."""
    joined = criteria.join(replies, list(keys), "left")
    failed = F.concat(F.lit("judge failure: "), F.coalesce("failure", F.lit("no reply")))
    return joined.select(
        *criteria.columns,
        F.coalesce("met", F.lit(False)).alias("met"),
        F.when(F.col("met").isNull(), failed).otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
    )


def majority(votes: DataFrame, keys: Sequence[str], judges: int) -> DataFrame:
    """Ensemble verdict: met when the MET votes exceed half of the configured judges, so a
    failed call counts against. The reason is that of the first judge that replied.

    ``votes`` holds ``judge, verdict, reason, hallucination``; failed calls are absent.
    """
    return votes.groupBy(*keys).agg(
        (F.count_if(F.col("verdict") == "MET") > judges / 2).alias("met"),
        F.count(F.lit(1)).alias("votes"),
        F.min_by("reason", "judge").alias("reason"),
        (F.count_if(F.col("hallucination")) > judges / 2).alias("hallucination_detected"),
    )


def _tier(tier: str) -> Column:
    return F.col("tier") == tier


def roll_up(
    verdicts: DataFrame, keys: Sequence[str], questions: DataFrame | None = None, signed_penalty: bool = False
) -> DataFrame:
    """Weighted, penalised and normalised score per key.

    ``category`` and ``hallucination`` come from the verdict rows, or from ``questions(<keys>,
    ..., category, hallucination)``, of which those without any verdict score 0. Criteria are
    counted first, in one aggregate with map-side combine, and only the one row per key meets the
    questions and the weights: a question with very many criteria costs no more than its share of
    the scan.
    ``signed_penalty`` adds the stored weight instead of deducting its size.
    """
    counts = [
        *[F.count_if(_tier(t) & F.col("met")).alias(f"_{t}_met") for t in TIERS],
        *[F.count_if(_tier(t)).alias(f"_{t}_all") for t in TIERS],
    ]
    if questions is None:
        counted = verdicts.groupBy(*keys).agg(
            F.first("category", ignorenulls=True).alias("category"),
            F.max("hallucination").alias("hallucination_detected"),
            *counts,
        )
        shown = list(keys)
    else:
        named = questions.withColumnRenamed("hallucination", "hallucination_detected")
        # A question without criteria stays, with counts of zero.
        counted = named.join(verdicts.groupBy(*keys).agg(*counts), list(keys), "left").fillna(
            0, [f"_{t}_{part}" for t in TIERS for part in ("met", "all")]
        )
        shown = [c for c in questions.columns if c not in ("category", "hallucination")]
    w = with_weights(counted)
    weight = lambda t: F.coalesce(F.col(f"weights.{t}"), F.lit(0.0))
    penalty = weight("hallucination") if signed_penalty else -F.abs(weight("hallucination"))
    out = w.select(
        *shown,
        "category",
        "hallucination_detected",
        *[(F.col(f"_{t}_met") * weight(t)).alias(f"{t}_earned") for t in TIERS],
        *[(F.col(f"_{t}_all") * weight(t)).alias(f"{t}_possible") for t in TIERS],
        F.when(F.col("hallucination_detected"), penalty).otherwise(0.0).alias("hallucination_penalty"),
        *[(F.col(f"_{t}_all") - F.col(f"_{t}_met")).alias(f"{t}_unmet") for t in TIERS],
    )
    total = lambda part: sum((F.col(f"{t}_{part}") for t in TIERS[1:]), F.col(f"{TIERS[0]}_{part}"))
    return (
        out.withColumn("raw_score", F.greatest(F.lit(0.0), total("earned") + F.col("hallucination_penalty")))
        .withColumn("max_score", total("possible"))
        .withColumn("normalized", ratio("raw_score", "max_score"))
        .withColumn("score", F.col("normalized"))
    )


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 4)).otherwise(0.0)


def gate(scored: DataFrame, dealbreaker: str = "critical") -> DataFrame:
    """Gated rescoring of ``roll_up`` rows: an unmet criterion in the dealbreaker tier or a
    hallucination zeroes the question. ``all_pass`` is 1 when nothing is unmet."""
    hallucinated = F.coalesce("hallucination_detected", F.lit(False))
    unmet = sum((F.col(f"{t}_unmet") for t in TIERS[1:]), F.col(f"{TIERS[0]}_unmet"))
    failed = (F.col(f"{dealbreaker}_unmet") > 0) | hallucinated
    return (
        scored.withColumn("ungated_normalized", ratio("raw_score", "max_score"))
        .withColumn("dealbreaker_failed", failed)
        .withColumn("all_pass", F.when((unmet == 0) & ~hallucinated, 1.0).otherwise(0.0))
        .withColumn("normalized", F.when(failed, 0.0).otherwise(F.col("ungated_normalized")))
        .withColumn("score", F.col("normalized"))
    )


def run_summary(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Count, average, least and greatest score rounded to 4; zeros for an empty run."""
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return scored.groupBy(*keys).agg(
        F.count("score").alias("count"),
        zero(F.avg("score")).alias("average_score"),
        zero(F.min("score")).alias("min_score"),
        zero(F.max("score")).alias("max_score"),
    )


def gated_summary(gated: DataFrame, keys: Sequence[str] = ("model",), dealbreaker: str = "critical") -> DataFrame:
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    return gated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        mean("score").alias("avg_gated"),
        mean("ungated_normalized").alias("avg_ungated"),
        mean("all_pass").alias("avg_all_pass"),
        F.lit(dealbreaker).alias("dealbreaker_tier"),
    )

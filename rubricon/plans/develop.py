"""From core facts to checked, enriched, de-duplicated and repaired rubrics.

Model calls stay outside: ``Steps`` names the callables that turn requests into reply
tables. Their results are stored before use, so none is asked twice for the same input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.functions.jsontext import find_json, tiered_facts
from rubricon.operators import rubrics
from rubricon.operators.grouping import exploded
from rubricon.plans.rubrics import dedupe_rubric, rubric_from_replies
from rubricon.session import durable

# Positions of one tier lie below the next one's.
_TIER = 1 << 59
RUBRIC = ["question", "tier", "pos", "fact"]
QUALITY = ["question", *rubrics.DIMENSIONS, "overall", "issue_count"]


@dataclass
class Steps:
    """``induce(facts)`` and ``repair(rubric, attempt)`` return ``(question, content)`` replies;
    ``check(rubric)`` returns one quality row per question; ``extract(rubric)`` returns new claims
    ``(question, model, cluster_id, pos, fact)``; ``cluster(rubric)`` returns
    ``(question, cluster_id, pos, fact)`` groups of equal criteria."""

    induce: Callable[[DataFrame], DataFrame]
    check: Callable[[DataFrame], DataFrame]
    extract: Callable[[DataFrame], DataFrame]
    repair: Callable[[DataFrame, int], DataFrame]
    cluster: Callable[[DataFrame], DataFrame] | None = None


def develop(
    core: DataFrame, steps: Steps, most: int = 5, attempts: int = 3, min_agreement: int = 2,
    threshold: float = rubrics.QUALITY_THRESHOLD,
) -> dict[str, DataFrame]:
    """``core(question, pos, fact)`` to the final rubric, its quality and the repair log."""
    rubric = durable(rubric_from_replies(steps.induce(core), core).select(RUBRIC))
    quality = durable(assessed(steps, rubric))
    for _ in range(most):
        todo = quality.where(rubrics.needs_enrichment()).select("question")
        grown = durable(enriched_facts(steps, of(rubric, todo), min_agreement))
        changed = grown.select("question").distinct()
        if grown.isEmpty():
            break
        renewed = rubric_from_replies(steps.induce(grown), grown).select(RUBRIC)
        if steps.cluster is not None:
            renewed = durable(renewed)
            renewed = dedupe_rubric(renewed, steps.cluster(renewed))["rubric"].select(RUBRIC)
        renewed = durable(renewed)
        rubric = durable(without(rubric, changed).unionByName(renewed))
        quality = durable(without(quality, changed).unionByName(assessed(steps, renewed)))
    log = None
    for n in range(1, most + 1):
        todo = quality.where(rubrics.needs_repair())
        if todo.isEmpty():
            break
        result, candidates, checked = repaired(steps, of(rubric, todo), todo, attempts, threshold)
        result = durable(result.withColumn("round", F.lit(n)))
        log = result if log is None else log.unionByName(result)
        won = result.where("repaired").select("question", F.col("best_attempt").alias("attempt"))
        if won.isEmpty():
            break
        renewed = durable(candidates.join(won, ["question", "attempt"], "left_semi").select(RUBRIC))
        rubric = durable(without(rubric, won).unionByName(renewed))
        # The winner was assessed as a candidate; a model is not asked again.
        kept = checked.join(won, ["question", "attempt"], "left_semi").drop("attempt")
        quality = durable(without(quality, won).unionByName(kept))
    return {"rubric": rubric, "quality": quality, "stats": rubrics.flat_stats(rubric), "repairs": log}


def of(rows: DataFrame, questions: DataFrame) -> DataFrame:
    return rows.join(questions.select("question"), "question", "left_semi")


def without(rows: DataFrame, questions: DataFrame) -> DataFrame:
    return rows.join(questions.select("question"), "question", "left_anti")


def assessed(steps: Steps, rubric: DataFrame) -> DataFrame:
    return steps.check(rubric).select(QUALITY).withColumn("recommendation", rubrics.next_step())


def enriched_facts(steps: Steps, rubric: DataFrame, min_agreement: int) -> DataFrame:
    """Old and agreed new facts of the questions that gained any, as ``question, pos, fact``."""
    fresh = rubrics.new_facts(steps.extract(rubric), rubric)
    agreed = (
        fresh.groupBy("question", "cluster_id")
        .agg(
            F.count_distinct("model").alias("_n"),
            F.max_by("fact", F.struct(F.length("fact"), -F.col("pos"))).alias("fact"),
        )
        .where(F.col("_n") >= min_agreement)
        .groupBy("question", "fact")
        .agg((F.lit(3 * _TIER) + F.min("cluster_id")).cast("long").alias("pos"))
    )
    old = of(rubric, agreed).groupBy("question", "fact").agg(
        F.min(rubrics.tier_priority(F.col("tier")).cast("long") * F.lit(_TIER) + F.col("pos")).alias("pos")
    )
    return old.unionByName(agreed.select(old.columns))


def repaired(
    steps: Steps, original: DataFrame, quality: DataFrame, attempts: int, threshold: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcome per question, and the candidate rubrics and their quality by attempt. Every attempt refines the last
    good one; figures are always compared with the original; questions that reach the
    threshold ask no more."""
    current, tried, candidates, checked = original, None, None, None
    open_questions = quality.select("question")
    for n in range(1, attempts + 1):
        asked = of(current, open_questions)
        replies = durable(steps.repair(asked, n))
        parsed = replies.select("question", find_json(F.col("content"), arrays=False).alias("value"))
        tiers = parsed.select("question", tiered_facts(F.col("value")).alias("_t"))
        new = durable(
            exploded(tiers, ["question"], F.col("_t"), "pos", "_c").select(
                "question", F.col("_c.tier").alias("tier"), "pos", F.col("_c.fact").alias("fact")
            )
        )
        invented = rubrics.invented_figures(original, new).select("question").distinct()
        clean = without(new, invented)
        quality_rows = durable(assessed(steps, clean))
        scores = quality_rows.select("question", F.col("overall").alias("score"))
        status = (
            F.when(F.col("_new").isNull(), "failed")
            .when(F.col("_bad").isNotNull(), "invented")
            .when(F.col("score").isNull(), "unchecked")
            .otherwise("ok")
        )
        flag = lambda df, c: df.select("question").distinct().withColumn(c, F.lit(True))
        outcome = durable(
            open_questions.join(flag(new, "_new"), "question", "left")
            .join(flag(invented, "_bad"), "question", "left")
            .join(scores, "question", "left")
            .select("question", F.lit(n).alias("attempt"), status.alias("status"), "score")
        )
        good = outcome.where("status = 'ok'").select("question")
        kept = of(clean, good).withColumn("attempt", F.lit(n))
        tried = outcome if tried is None else tried.unionByName(outcome)
        candidates = kept if candidates is None else candidates.unionByName(kept)
        quality_rows = quality_rows.withColumn("attempt", F.lit(n))
        checked = quality_rows if checked is None else checked.unionByName(quality_rows)
        current = durable(without(asked, good).unionByName(of(clean, good)))
        open_questions = outcome.where(
            (F.col("status") != "failed") & (F.coalesce("score", F.lit(-1.0)) < threshold)
        ).select("question")
        if open_questions.isEmpty():
            break
    originals = quality.select("question", F.col("overall").alias("original_score"))
    return rubrics.best_attempt(originals, tried, threshold), candidates, checked

"""Rubric building, de-duplication, repair and the enrich/repair rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.functions.jsontext import find_json, tiered_facts
from rubricon.operators import rubrics
from rubricon.operators.grouping import exploded
from rubricon.session import durable


def rubric_from_replies(replies: DataFrame, facts: DataFrame) -> DataFrame:
    """Induced rubric from reply texts ``(question, content)`` and source facts
    ``(question, pos, fact)``, put back onto the facts so that none is lost or invented."""
    parsed = replies.select("question", find_json(F.col("content")).alias("value"))
    tiered = parsed.select("question", tiered_facts(F.col("value")).alias("_t"))
    induced = exploded(tiered, ["question"], F.col("_t"), "pos", "_c").select("question", F.col("_c.tier").alias("tier"), "pos", F.col("_c.fact").alias("fact"))
    return rubrics.repaired_assignment(induced, facts)


def dedupe_rubric(rubric: DataFrame, clusters: DataFrame, wordings: DataFrame | None = None) -> dict[str, DataFrame]:
    """Collapse clusters of equal criteria to one criterion in their highest tier.

    ``clusters(question, cluster_id, pos, fact)``; ``wordings(question, cluster_id, wording)``
    replaces the longest member's text. The check against the old facts only warns.
    """
    merged = rubrics.cluster_tiers(clusters, rubric)
    if wordings is not None:
        merged = (
            merged.join(wordings, ["question", "cluster_id"], "left")
            .withColumn("fact", F.when(F.col("members") > 1, F.coalesce("wording", "fact")).otherwise(F.col("fact")))
            .drop("wording")
        )
    flat = merged.select("question", "tier", F.col("cluster_id").alias("pos"), "fact")
    return {
        "rubric": flat,
        "stats": rubrics.flat_stats(flat),
        "warnings": rubrics.validation(flat, rubric.select("question", "fact")),
    }


def repair_round(originals: DataFrame, attempts: DataFrame, threshold: float = rubrics.QUALITY_THRESHOLD) -> DataFrame:
    return rubrics.best_attempt(originals, attempts, threshold)


def rounds(
    records: DataFrame,
    wanted: Callable[[], object],
    step: Callable[[DataFrame, int], DataFrame],
    most: int = 5,
) -> DataFrame:
    """Apply ``step`` to the records that still ask for it, up to ``most`` times.

    Finished records leave the loop, so its input shrinks. The state of every round is
    written to reliable storage: the plan stays short, model calls inside ``step`` are not
    repeated, and a lost executor costs nothing but its own tasks.
    """
    state = records
    for n in range(1, most + 1):
        todo = state.where(wanted())
        if todo.isEmpty():
            break
        state = durable(state.where(~F.coalesce(wanted(), F.lit(False))).unionByName(step(todo, n)))
    return state

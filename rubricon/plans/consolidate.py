"""Consensus facts of a set of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.operators import consensus


def consolidate(
    facts: DataFrame,
    claim_steps: DataFrame,
    wordings: DataFrame | None = None,
    skipped: DataFrame | None = None,
    min_agreement: int = consensus.MIN_AGREEMENT,
    family: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Quantitative facts are grouped by period and amount; qualitative ones follow the merge
    steps. Returns all marked facts, the core ones, and totals per question."""
    keys = ["question", "period", "bucket"]
    quant = consensus.clusters(consensus.bucketed(facts), keys)
    if wordings is not None:
        quant = consensus.canonical(quant, wordings, keys)
    cols = ["question", "fact", "agreed_by", "agreement_count"]
    marked = consensus.agreement(
        quant.select(*cols, F.lit("quantitative").alias("fact_type")).unionByName(
            consensus.merged_claims(claim_steps, skipped).select(*cols, F.lit("qualitative").alias("fact_type"))
        ),
        min_agreement,
        family,
    )
    return {
        "marked": marked,
        "core": marked.where("core").drop("core", "family_only"),
        "totals": consensus.question_totals(marked),
    }

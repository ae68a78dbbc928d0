"""Leaderboards, rankings, advantages, winners and pivots over scored rows.

Input rows are ``(model, question, <group>, score)``. Raw rows are read once by
``score_summary``; every window below runs on the aggregated frame, whose size is
models x groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon.operators.grouping import first_by, score_summary


def leaderboard(scores: DataFrame) -> DataFrame:
    """One row per model with rank 1..n by mean; ties go to the smaller model name."""
    out = score_summary(scores, ["model"], "score")
    w = Window.orderBy(F.desc("mean_score"), F.asc("model"))
    return out.withColumn("rank", F.row_number().over(w))


def group_scores(scores: DataFrame, group: str) -> DataFrame:
    """Mean, median and count per group and model; rows without group are left out."""
    return score_summary(scores, [group, "model"], "score").select(
        group, "model", "mean_score", "median_score", F.col("n").alias("count")
    )


def dense_ranks(summary: DataFrame, group: str) -> DataFrame:
    """Dense rank by mean within the group, as a double; a missing mean has no rank."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("mean_score"))
    rank = F.when(F.col("mean_score").isNotNull(), F.dense_rank().over(w)).cast("double")
    return summary.withColumn(f"rank_within_{group}", rank)


def row_ranks(summary: DataFrame, group: str) -> DataFrame:
    """1..n by mean within the group; ties go to the smaller model name."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("mean_score"), F.asc("model"))
    return summary.withColumn("rank", F.row_number().over(w))


def advantages(summary: DataFrame, group: str) -> DataFrame:
    """Distance of a model's mean from the plain mean of all model means of the group."""
    average = F.avg("mean_score").over(Window.partitionBy(group))
    return summary.withColumn(f"{group}_average", average).withColumn(
        "advantage", F.col("mean_score") - F.col(f"{group}_average")
    )


def specialists(advantage: DataFrame, group: str) -> DataFrame:
    """Per group the first non-null value of every column, by advantage descending."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("advantage"), F.asc("model"))
    ranked = advantage.withColumn("_rn", F.row_number().over(w))
    rest = [c for c in advantage.columns if c != group]
    return ranked.groupBy(group).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(c) for c in rest]
    )


def winners(summary: DataFrame, group: str) -> DataFrame:
    """The whole row with the best mean of every group."""
    order = [-F.coalesce(F.col("mean_score"), F.lit(float("-inf"))), F.col("model")]
    return first_by(summary, [group], order)


def heatmap(summary: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    return summary.groupBy(group).pivot("model", list(models)).agg(F.avg("mean_score"))


def rank_matrix(ranked: DataFrame, group: str, models: Sequence[str]) -> DataFrame:
    """Ranks as a group x model matrix; a repeated pair is an error."""
    once = F.when(F.count("rank") > 1, F.raise_error(F.lit("duplicate group and model"))).otherwise(
        F.first("rank")
    )
    return ranked.groupBy(group).pivot("model", list(models)).agg(once.cast("int"))

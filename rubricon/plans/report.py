"""All report tables from scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rubricon.operators import reports


def report_tables(scores: DataFrame, models: Sequence[str]) -> dict[str, DataFrame]:
    """Leaderboard plus, for domain and workflow, scores, rankings, advantage, specialists,
    winners, heatmap and rank matrix. The raw rows are aggregated once per grouping; all
    else derives from those small frames."""
    out = {"overall_leaderboard": reports.leaderboard(scores)}
    for g in ("domain", "workflow"):
        summary = reports.group_scores(scores, g).persist()
        ranked = reports.row_ranks(summary, g)
        advantage = reports.advantages(summary, g)
        dense = reports.dense_ranks(summary, g)
        out |= {
            f"{g}_scores": dense,
            f"{g}_rankings": ranked,
            f"{g}_advantage": advantage,
            f"best_{g}_specialists": reports.specialists(advantage, g),
            f"{g}_winners": reports.winners(dense, g),
            f"{g}_heatmap": reports.heatmap(summary, g, models),
            f"{g}_rank_matrix": reports.rank_matrix(ranked, g, models),
        }
    return out

"""Ranks, advantages and specialists of small hand-made group means."""

import pytest
from pyspark.sql import functions as F

from rubricon.operators import reports

# Mean score per group and model (a-e), with the question count of the group.
MEANS = {
    1: (2, [0.50, 0.75, 1.00, 0.25, 0.00]),
    2: (4, [0.80, 0.70, 0.60, 0.50, 0.40]),
    3: (4, [0.10, 0.30, 0.20, 0.10, 0.05]),
}
# Best model of the group, the group's average and the winner's advantage, worked out by hand.
BEST = {1: ("c", 0.5, 0.5), 2: ("a", 0.6, 0.2), 3: ("b", 0.15, 0.15)}
MODELS = list("abcde")


@pytest.fixture(scope="module")
def summary(spark):
    rows = [(str(g), m, v, v, n) for g, (n, vs) in MEANS.items() for m, v in zip(MODELS, vs)]
    return spark.createDataFrame(rows, "workflow string, model string, mean_score double, median_score double, count long")


def test_specialists_and_advantage(summary):
    got = {int(r["workflow"]): r for r in reports.specialists(reports.advantages(summary, "workflow"), "workflow").collect()}
    for g, (model, average, advantage) in BEST.items():
        assert got[g]["model"] == model
        assert got[g]["workflow_average"] == pytest.approx(average, abs=1e-12)
        assert got[g]["advantage"] == pytest.approx(advantage, abs=1e-12)


def test_rankings_matrix_and_heatmap(summary):
    ranked = reports.row_ranks(summary, "workflow")
    order = [r["model"] for r in ranked.where("workflow = '1'").orderBy("rank").collect()]
    assert order == ["c", "b", "a", "d", "e"]
    matrix = {r["workflow"]: [r[m] for m in MODELS] for r in reports.rank_matrix(ranked, "workflow", MODELS).collect()}
    assert matrix["2"] == [1, 2, 3, 4, 5]
    assert matrix["3"] == [3, 1, 2, 4, 5]
    heat = {r["workflow"]: [r[m] for m in MODELS] for r in reports.heatmap(summary, "workflow", MODELS).collect()}
    assert heat["3"] == MEANS[3][1]
    with pytest.raises(Exception, match="duplicate group and model"):
        reports.rank_matrix(ranked.unionByName(ranked), "workflow", MODELS).collect()


def test_dense_ranks_leave_missing_means_unranked(spark):
    s = spark.createDataFrame(
        [("g", "a", 0.5), ("g", "b", 0.5), ("g", "c", 0.4), ("g", "d", None)], "domain string, model string, mean_score double"
    )
    got = {r["model"]: r["rank_within_domain"] for r in reports.dense_ranks(s, "domain").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 2.0, "d": None}
    assert reports.winners(s, "domain").first()["model"] == "a"


def test_specialists_take_the_first_value_per_column(spark):
    s = spark.createDataFrame(
        [("g", "a", 0.9, None, 0.4), ("g", "b", 0.5, 0.7, 0.1)],
        "domain string, model string, mean_score double, median_score double, advantage double",
    )
    r = reports.specialists(s, "domain").first()
    assert (r["model"], r["mean_score"], r["median_score"]) == ("a", 0.9, 0.7)


def test_leaderboard_means_from_group_means(spark):
    rows = [(m, v) for _, (n, vs) in MEANS.items() for m, v in zip(MODELS, vs) for _ in range(n)]
    got = reports.leaderboard(spark.createDataFrame(rows, "model string, score double")).select("model", "rank", F.round("mean_score", 4), "n").collect()
    # b: (2 * 0.75 + 4 * 0.7 + 4 * 0.3) / 10, and so on.
    assert [(r["model"], r[2], r["n"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        ("b", 0.55, 10), ("c", 0.52, 10), ("a", 0.46, 10), ("d", 0.29, 10), ("e", 0.18, 10),
    ]

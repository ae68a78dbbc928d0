import random

import pytest
from pyspark.sql import functions as F

from rubricon.operators import grading, replies
from rubricon.operators.grouping import tasks_for
from rubricon.plans import grade
from rubricon.plans.grade import grade_answers

W = {c: dict(critical=a, important=b, optional=o, hallucination=h) for c, a, b, o, h in grading.WEIGHTS}


def by_hand(items, category, hallucinated):
    w = W[category]
    raw = sum(w[t] for t, met in items if met)
    top = sum(w[t] for t, _ in items)
    raw = max(0.0, raw - abs(w["hallucination"]) * hallucinated)
    return raw, top, round(raw / top, 4) if top else 0.0


def test_roll_up_equals_hand_computation(spark):
    rnd = random.Random(9)
    cases = {
        q: ([(rnd.choice(grading.TIERS), rnd.random() < 0.6) for _ in range(rnd.randrange(1, 9))], rnd.choice(grading.CATEGORIES), rnd.random() < 0.3)
        for q in range(300)
    }
    rows = [("m", q, t, met, c, h) for q, (items, c, h) in cases.items() for t, met in items]
    v = spark.createDataFrame(rows, "model string, question long, tier string, met boolean, category string, hallucination boolean")
    for r in grading.gate(grading.roll_up(v, ["model", "question"])).collect():
        items, c, h = cases[r["question"]]
        raw, top, norm = by_hand(items, c, h)
        assert (r["raw_score"], r["max_score"]) == (raw, top)
        assert r["ungated_normalized"] == pytest.approx(norm, abs=1e-4)
        failed = h or any(t == "critical" and not m for t, m in items)
        assert r["dealbreaker_failed"] == failed and r["score"] == (0.0 if failed else r["ungated_normalized"])
        assert r["all_pass"] == float(all(m for _, m in items) and not h)


def test_question_attributes_can_come_separately(spark):
    v = spark.createDataFrame([(1, "critical", True), (1, "optional", False)], "question long, tier string, met boolean")
    q = spark.createDataFrame([(1, "m", "forensic", False), (2, "m", "forensic", False)], "question long, model string, category string, hallucination boolean")
    r = grading.roll_up(v, ["question"], q).collect()
    assert sorted((x["model"], x["question"], x["score"]) for x in r) == [("m", 1, 0.8333), ("m", 2, 0.0)]


def test_models_of_one_question_are_scored_apart(spark):
    c = spark.createDataFrame([(1, "critical", "a"), (1, "optional", "b")], "question long, tier string, fact string")
    a = spark.createDataFrame(
        [(1, "good", "forensic", False), (1, "bad", "forensic", False), (2, "bad", "forensic", False)],
        "question long, model string, category string, hallucination boolean",
    )
    r = spark.createDataFrame(
        [(m, f, m == "good", "", None) for m in ("good", "bad") for f in "ab"],
        "model string, fact string, met boolean, reason string, failure string",
    )
    out = grade_answers(c, a, r, ["model", "fact"])
    assert {(x["model"], x["question"]): x["score"] for x in out["scores"].collect()} == {("good", 1): 1.0, ("bad", 1): 0.0, ("bad", 2): 0.0}
    assert {x["model"]: (x["count"], x["average_score"]) for x in out["summary"].collect()} == {"good": (1, 1.0), "bad": (2, 0.0)}


def test_unknown_category_scores_zero(spark):
    v = spark.createDataFrame([("m", 1, "critical", True, "odd", False)], "model string, question long, tier string, met boolean, category string, hallucination boolean")
    r = grading.roll_up(v, ["model", "question"]).first()
    assert (r["max_score"], r["score"]) == (0.0, 0.0)


def test_majority_counts_failed_calls_against(spark):
    rows = [(1, 1, "MET", "r1", True), (1, 2, "MET", "r2", True), (2, 3, "MET", "r3", False), (3, 1, "UNMET", "r4", False)]
    v = spark.createDataFrame(rows, "question int, judge int, verdict string, reason string, hallucination boolean")
    got = {r["question"]: (r["met"], r["reason"], r["hallucination_detected"]) for r in grading.majority(v, ["question"], 3).collect()}
    assert got == {1: (True, "r1", True), 2: (False, "r3", False), 3: (False, "r4", False)}


def test_pairing_needs_equal_counts(spark):
    with pytest.raises(ValueError, match="rubric count 2"):
        grading.pair_with_answers(spark.range(2).toDF("question"), spark.range(3).toDF("question"))


def test_empty_summary_is_zero(spark):
    empty = spark.createDataFrame([], "model string, score double, ungated_normalized double, all_pass double")
    assert grading.run_summary(empty, []).first().asDict() == {"count": 0, "average_score": 0.0, "min_score": 0.0, "max_score": 0.0}
    assert grading.gated_summary(empty, []).first()["avg_gated"] == 0.0


def test_grading_plan(spark):
    c = spark.createDataFrame([(1, "critical", "a"), (1, "important", "b"), (2, "critical", "a")], "question long, tier string, fact string")
    q = spark.createDataFrame([(1, "m", "governance", False), (2, "m", "governance", True)], "question long, model string, category string, hallucination boolean")
    r = spark.createDataFrame([("a", True, "ok", None)], "fact string, met boolean, reason string, failure string")
    out = grade_answers(c, q, r, ["fact"])
    assert sorted((x["fact"], x["met"], x["reason"]) for x in out["verdicts"].collect()) == [
        ("a", True, "ok"), ("a", True, "ok"), ("b", False, "judge failure: no reply"),
    ]
    assert {x["question"]: (x["score"], x["ungated_normalized"]) for x in out["gated"].collect()} == {1: (0.6667, 0.6667), 2: (0.0, 0.4)}
    assert out["gated_summary"].first()["avg_ungated"] == pytest.approx(0.53335, abs=1e-4)


def test_grading_deals_answers_to_tasks_of_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(grade, "tasks_for", lambda df: tasks_for(df, rows=20), raising=False)
    models = ["m1", "m2", "m3"]
    c = [(q, random.Random(q).choice(grading.TIERS), f"f{(q + i) % 7}") for q in range(100) for i in range(q % 5)]
    c += [(50, "critical", "f0")] * 300 + [(50, "optional", None), (None, "critical", "f1")]
    a = [(q, m, "forensic", q % 9 == 0) for q in range(100) for m in models] + [(1, "m1", "modeling", False)]
    r = [(m, f"f{i}", (i + len(m) * int(m[1])) % 3 == 0, "", None) for m in models for i in range(6)] + [("m2", "f3", True, "", None), ("m2", None, True, "", None)]
    out = grade_answers(
        spark.createDataFrame(c, "question long, tier string, fact string"),
        spark.createDataFrame(a, "question long, model string, category string, hallucination boolean"),
        spark.createDataFrame(r, "model string, fact string, met boolean, reason string, failure string"),
        ["model", "fact"],
    )
    met = lambda m, f: [x[2] for x in r if x[0] == m and x[1] == f and f] or [False]
    expected = []
    for q, m, category, h in a:
        times = sum(x[:2] == (q, m) for x in a)
        items = [(t, v) for x, t, f in c if x == q for v in met(m, f)] * times
        expected.append((q, m, *by_hand(items, category, h)[:2]))
    got = [(x["question"], x["model"], x["raw_score"], x["max_score"]) for x in out["scores"].collect()]
    assert sorted(got) == sorted(expected)
    # 301 answers in tasks of 20, whatever the session's number, and no answers broadcast
    plan = out["scores"]._jdf.queryExecution().executedPlan().toString()
    assert "question" in plan and ", 16), REPARTITION_BY_NUM" in plan
    assert "BroadcastHashJoin [question" not in plan


def test_replies_fail_per_batch_and_are_read_once(spark):
    reqs = replies.request_rows(spark.range(10), "s", ["id"], replies.render("n={n} {{x}}", n=F.col("id")))
    assert reqs.orderBy("id").select("prompt").first()[0] == "n=0 {{x}}"

    def fn(prompts):
        if any("n=7" in p for p in prompts):
            raise RuntimeError("down")
        return ['{"ok": true}' for _ in prompts]

    rows = replies.score_requests(reqs.coalesce(1), fn, batch=5)
    assert rows.groupBy("status").count().orderBy("status").collect()[0].asDict() == {"status": "failed", "count": 5}
    read = replies.read_replies(reqs, rows)
    good, bad = replies.split_failures(read)
    assert (good.count(), bad.count()) == (5, 5)
    cut = rows.withColumn("finish_reason", F.lit("length"))
    assert replies.usable(cut).count() == 0

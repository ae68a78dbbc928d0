import random

import pytest
from pyspark.sql import functions as F

from rubricon.operators import consensus, documents, rubrics
from rubricon.plans.rubrics import dedupe_rubric, rounds

FLAT = "question long, tier string, pos int, fact string"


def test_untraceable_equals_brute_force(spark):
    rnd = random.Random(10)
    words = ["Rev", "revenue", "up", "5%", "in", "Q1", "a", "EBITDA", "é"]
    make = lambda n: [" ".join(rnd.choices(words, k=rnd.randrange(1, 5))) for _ in range(n)]
    rows = {q: (make(8), make(8) + ["u", "up"]) for q in range(40)}
    o = spark.createDataFrame([(q, "critical", i, f) for q, (a, _) in rows.items() for i, f in enumerate(a)], FLAT)
    r = spark.createDataFrame([(q, "critical", i, f) for q, (_, b) in rows.items() for i, f in enumerate(b)], FLAT)
    got = {tuple(x) for x in rubrics.untraceable(o, r).select("question", "fact").collect()}
    want = {
        (q, f)
        for q, (a, b) in rows.items()
        for f in b
        if not any(f.lower() in x.lower() or x.lower() in f.lower() for x in a)
    }
    assert got == want and want


def test_untraceable_compares_small_questions_in_one_join(spark):
    facts = ["Part 1 shipped 2 units", "", None, "part"]
    o = spark.createDataFrame([(1, "critical", 0, facts[0]), (2, "critical", 0, ""), (3, "critical", 0, None), (None, "critical", 0, "a")], FLAT)
    big = [(4, "critical", i, f"fact {i}") for i in range(40)]
    r = spark.createDataFrame([(q, "critical", 0, f) for q in (1, 2, 3, None) for f in [*facts, "a", "a"]], FLAT)
    asked = [(4, "critical", 0, "Fact 7"), (4, "critical", 1, "fact 77"), (4, "critical", 2, "else")]
    out = rubrics.untraceable(o, r)
    got = sorted(map(tuple, out.collect()), key=str)
    every = ["", "Part 1 shipped 2 units", "a", "part", None]
    want = [(1, ""), (1, None), (2, "Part 1 shipped 2 units"), (2, "a"), (2, "part"), (2, None), *[(q, f) for q in (3, None) for f in every]]
    assert got == sorted(want, key=str)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 3
    both = rubrics.untraceable(o.unionByName(spark.createDataFrame(big, FLAT)), r.unionByName(spark.createDataFrame(asked, FLAT)))
    assert sorted(map(tuple, both.collect()), key=str) == sorted([*got, (4, "else")], key=str)


def test_repaired_assignment(spark):
    facts = spark.createDataFrame([(1, 0, "Alpha Fact"), (1, 1, "beta"), (1, 2, "gamma")], "question long, pos int, fact string")
    r = spark.createDataFrame(
        [(1, "critical", 0, " alpha  fact"), (1, "critical", 1, "ALPHA FACT"), (1, "optional", 0, "unknown"), (1, "optional", 1, "beta")], FLAT
    )
    got = sorted((x["tier"], x["fact"], x["appended"]) for x in rubrics.repaired_assignment(r, facts).collect())
    assert got == [("critical", "Alpha Fact", False), ("important", "gamma", True), ("optional", "beta", False)]


def test_best_attempt_rules(spark):
    orig = spark.createDataFrame([(q, 0.5) for q in range(1, 7)], "question long, original_score double")
    rows = [
        (1, 1, "ok", 0.6), (1, 2, "ok", 0.75), (1, 3, "ok", 0.9),
        (2, 1, "ok", 0.4), (2, 2, "ok", 0.5),
        (3, 1, "invented", None), (3, 2, "unchecked", None),
        (4, 1, "ok", 0.55), (4, 2, "failed", None), (4, 3, "ok", 0.99),
        (5, 1, "ok", 0.65), (5, 2, "ok", 0.65),
    ]
    a = spark.createDataFrame(rows, "question long, attempt int, status string, score double")
    got = {r["question"]: (r["outcome"], r["best_attempt"], r["final_score"], r["attempts_used"]) for r in rubrics.best_attempt(orig, a).collect()}
    assert got == {
        1: ("repaired", 2, 0.75, 2),
        2: ("kept_original", 2, 0.5, 2),
        3: ("reverted", None, 0.5, 2),
        4: ("repaired", 1, 0.55, 2),
        5: ("repaired", 1, 0.65, 2),
        6: ("reverted", None, 0.5, 0),
    }


def test_enrichment_statuses(spark):
    rec = spark.createDataFrame(
        [(1, "stop", 0, 0.9), (2, "enrich", 0, 0.9), (3, "enrich", 0, 0.9), (4, "enrich", 0, 0.9), (5, "enrich", 0, 0.9), (6, None, 1, 0.9), (7, "", 0, None)],
        "question long, recommendation string, issue_count int, overall double",
    )
    ans = spark.createDataFrame([(q, "m") for q in (1, 3, 4, 5, 6, 7)], "question long, model string")
    cand = spark.createDataFrame(
        [(3, "m", 0, 0, "known"), (4, "m", 0, 0, "new"), (5, "m", 0, 0, "x"), (5, "n", 1, 0, "y"), (6, "m", 0, 0, "z"), (6, "n", 0, 0, "zz")],
        "question long, model string, cluster_id int, pos int, fact string",
    )
    rub = spark.createDataFrame([(3, "critical", 0, "known")], FLAT)
    got = {r["question"]: (r["status"], r["added_facts"], r["flag_reason"]) for r in rubrics.enrichment(rec, ans, cand, rub).collect()}
    assert got == {
        1: ("skipped", 0, None),
        2: ("skipped_no_answers", 0, None),
        3: ("no_new_facts", 0, None),
        4: ("manual_review_required", 0, "gap_unresolved_single_model"),
        5: ("manual_review_required", 0, "gap_unresolved_below_agreement"),
        6: ("enriched", 1, None),
        7: ("no_new_facts", 0, None),
    }


def test_contradictions(spark):
    c = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 2), (1, 3, 1)], "question long, cluster_id int, agreement_count int")
    p = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "question long, cluster_a int, cluster_b int")
    got = {r["cluster_id"]: r["outcome"] for r in rubrics.resolve_contradictions(c, p).collect()}
    assert got == {0: "kept", 1: "review", 2: "review", 3: "kept"}


def test_dedupe_keeps_the_highest_tier(spark):
    r = spark.createDataFrame([(1, "critical", 0, "a"), (1, "optional", 0, "a b"), (1, "important", 0, "c")], FLAT)
    c = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "a b"), (1, 1, 2, "c"), (1, 2, 3, "foreign")], "question long, cluster_id int, pos int, fact string")
    w = spark.createDataFrame([(1, 0, "A and B"), (1, 1, "unused")], "question long, cluster_id int, wording string")
    out = dedupe_rubric(r, c, w)
    assert sorted((x["tier"], x["fact"]) for x in out["rubric"].collect()) == [("critical", "A and B"), ("important", "c"), ("optional", "foreign")]
    assert out["warnings"].first()["error"] == "omitted facts"


def test_rounds_stop_when_nothing_asks(spark):
    seen = []

    def step(todo, n):
        seen.append(todo.count())
        better = todo.withColumn("overall", F.round(F.col("overall") + 0.3, 1))
        return better.withColumn("recommendation", F.when(F.col("overall") >= 0.7, "stop").otherwise("enrich"))

    df = spark.createDataFrame([(1, "enrich", 0.5), (2, "enrich", 0.1), (3, "stop", 1.0), (4, None, 0.2)], "question long, recommendation string, overall double")
    wanted = lambda: F.col("recommendation") == "enrich"
    out = rounds(df, wanted, step, most=5)
    assert seen == [2, 1]
    assert out.count() == 4 and out.where(wanted()).count() == 0
    seen.clear()
    assert rounds(df, wanted, step, most=1).where(wanted()).count() == 1


def test_family_and_agreement(spark):
    rows = [("q", "c", m, i, f) for i, (m, f) in enumerate([("g1", "x 10"), ("g2", "x 10.4"), ("k", "y 300"), ("g1", "y 301")])]
    f = spark.createDataFrame(rows, "question string, category string, model string, pos int, fact string")
    c = consensus.clusters(consensus.bucketed(f), ["question", "period", "bucket"])
    got = {r["bucket"]: (r["core"], r["family_only"]) for r in consensus.agreement(c, 2, ["g2", "g1"]).collect()}
    assert got == {10: (False, True), 300: (True, False)}


def test_merge_skips_failed_models(spark):
    s = spark.createDataFrame([("q", 1, "a", 0, "f"), ("q", 2, "b", 0, "f better"), ("q", 3, "c", 1, "g")], "question string, step int, model string, claim int, fact string")
    skip = spark.createDataFrame([("q", "c")], "question string, model string")
    got = [(r["fact"], r["agreed_by"]) for r in consensus.merged_claims(s, skip).collect()]
    assert got == [("f better", ["a", "b"])]


def test_patch_needs_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in rubrics.patch_one(df, F.col("k") == 1, "v", "z").collect()} == {(1, "z"), (2, "b"), (2, "c")}
    for k in (2, 3):
        with pytest.raises(ValueError):
            rubrics.patch_one(df, F.col("k") == k, "v", "z")


def test_prompts(spark):
    store = spark.createDataFrame([("doc_a", "{{doc_b}} and 0123456789"), ("doc_b", "B")], "key string, text string")
    p = spark.createDataFrame(
        [(1, "x {{doc_a}} y {{doc_b}}"), (2, "{{ doc  a }}"), (3, "none"), (4, "{{doc_a}}{{doc_a}}!"), (5, "{{doc_b}}")], "prompt_id int, prompt string"
    )
    rng = spark.createDataFrame([(4, "doc_a", -3, 100), (5, "doc_a", 0, 1)], "prompt_id int, key string, start int, end int")
    got = {r["prompt_id"]: (r["text"], r["error"]) for r in documents.fill_prompts(p, store, rng).collect()}
    assert got == {
        1: ("x {{doc_b}} and 0123456789 y B", None),
        2: (None, "unknown key"),
        3: (None, "no reference"),
        4: ("789789!", None),
        5: (None, "range for a key that is not referenced"),
    }
    keys = {(r["prompt_id"], r["ref_pos"]): r["key"] for r in documents.resolve_keys(p, store).collect()}
    assert keys[(2, 0)] == "doc_a" and keys[(3, 0)] is None
    only = documents.resolve_keys(p, store.where("key = 'doc_b'"))
    assert {r["key"] for r in only.where("prompt_id = 3").collect()} == {"doc_b"}


def test_develop_enriches_then_repairs(spark):
    from rubricon.operators.grading import TIERS
    from rubricon.plans.develop import Steps, develop

    core = spark.createDataFrame([(1, 0, "a 1"), (1, 1, "b 2"), (2, 0, "c 3")], "question long, pos long, fact string")
    asked = []

    def packed(rows, tier):
        rows = rows.withColumn("_t", tier)
        cols = [F.collect_list(F.when(F.col("_t") == t, F.col("fact"))).alias(t) for t in TIERS]
        return rows.groupBy("question").agg(*cols).select("question", F.to_json(F.struct(*TIERS)).alias("content"))

    def check(rubric):
        s = rubrics.flat_stats(rubric)
        good = F.when(F.col("n_optional") > 0, 0.96).otherwise(0.5)
        return s.select(
            "question", F.lit(1.0).alias("specificity"), F.lit(1.0).alias("atomicity"), good.alias("tier_correctness"),
            F.when(F.col("total") >= 2, 1.0).otherwise(0.5).alias("coverage"), good.alias("overall"), F.lit(1).alias("issue_count"),
        )

    def repair(rubric, attempt):
        asked.append((attempt, rubric.select("question").distinct().count()))
        # Question 2 gets an invented figure first.
        fact = F.when((F.col("question") == 2) & F.lit(attempt == 1), F.concat("fact", F.lit(" 99"))).otherwise(F.col("fact"))
        return packed(rubric.withColumn("fact", fact), F.lit("optional"))

    claims = spark.createDataFrame(
        [(2, "m", 0, 0, "d 4"), (2, "n", 0, 1, "d  4!"), (2, "m", 1, 2, "lonely")], "question long, model string, cluster_id int, pos int, fact string"
    )
    steps = Steps(
        induce=lambda f: packed(f, F.lit("critical")),
        check=check,
        extract=lambda r: claims.join(r.select("question").distinct(), "question", "left_semi"),
        repair=repair,
    )
    out = develop(core, steps)
    got = sorted((r["question"], r["tier"], r["fact"]) for r in out["rubric"].collect())
    assert got == [(1, "optional", "a 1"), (1, "optional", "b 2"), (2, "optional", "c 3"), (2, "optional", "d  4!")]
    assert {r["question"]: (r["outcome"], r["best_attempt"]) for r in out["repairs"].collect()} == {1: ("repaired", 1), 2: ("repaired", 2)}
    assert asked == [(1, 2), (2, 1)]
    assert out["quality"].where("recommendation <> 'stop'").count() == 0


def test_validation_joins_nothing_and_null_equals_nothing(spark):
    rubric = [("q", "critical", 0, "a"), ("q", "critical", 1, "a"), ("q", "optional", 2, "b"), ("q", "optional", 3, None), (None, "optional", 0, "a"), ("ok", "critical", 0, "z")]
    r = spark.createDataFrame(rubric, "question string, tier string, pos int, fact string")
    f = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", None), (None, "a"), ("ok", "z"), ("ok", "z")], "question string, fact string")
    out = rubrics.validation(r, f)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x["question"]: (x["missing"], x["extra"], x["duplicates"], x["error"]) for x in out.collect()}
    assert got == {"q": (2, 2, 1, "omitted facts"), None: (1, 1, 0, "omitted facts"), "ok": (0, 0, 0, None)}


def test_assignment_keeps_one_row_per_tier_and_appends_the_rest(spark):
    r = spark.createDataFrame([("q", "critical", 4, " A  b"), ("q", "critical", 2, "a B"), ("q", "optional", 1, "a b"), ("q", "optional", 0, "new")], "question string, tier string, pos int, fact string")
    f = spark.createDataFrame([("q", 0, "a b"), ("q", 1, "A b"), ("q", 2, "c"), ("q", 3, None)], "question string, pos int, fact string")
    got = {(x["tier"], x["pos"], x["fact"], x["appended"]) for x in rubrics.repaired_assignment(r, f).collect()}
    assert got == {("critical", 2, "A b", False), ("optional", 1, "A b", False), ("important", 0, "a b", True), ("important", 2, "c", True), ("important", 3, None, True)}

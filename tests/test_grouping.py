import random
import statistics

from pyspark.sql import functions as F

from rubricon.operators import grouping


def skewed(n, seed):
    """Rows (g, v, i); one group holds most rows and values repeat."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(20)}", round(rnd.gauss(0, 10), 1), i) for i in range(n)]


def test_median_is_exact_under_skew(spark):
    rows = skewed(5000, 1)
    df = spark.createDataFrame(rows, "g string, v double, i long")
    # Without merging them, the hot group is spread over most of the ranges.
    for merged in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        got = {r["g"]: r for r in grouping.score_summary(df, ["g"], "v").collect()}
        for g in {r[0] for r in rows}:
            v = [r[1] for r in rows if r[0] == g]
            assert got[g]["median_score"] == statistics.median(v)
            assert got[g]["n"] == len(v) and got[g]["min_score"] == min(v) and got[g]["max_score"] == max(v)


def test_summary_drops_null_groups_and_keeps_null_values_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None)], "g string, v double")
    got = {r["g"]: (r["mean_score"], r["median_score"], r["n"]) for r in grouping.score_summary(df, ["g"], "v").collect()}
    assert got == {"a": (1.0, 1.0, 1), "b": (None, None, 0)}


def test_nan_counts_as_null(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 2.0), ("b", nan), ("c", inf), ("c", 3.0), ("c", 4.0)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in grouping.score_summary(df, ["g"], "v").collect()}
    assert got == {"a": (1.5, 1.5, 1.0, 2.0, 2), "b": (None, None, None, None, 0), "c": (inf, 4.0, 3.0, inf, 3)}


def test_ranked_equals_sorting(spark):
    rows = skewed(3000, 4)
    df = spark.createDataFrame(rows, "g string, v double, i long")
    for merged in ("false", "true"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
        got = {(r["g"], r["i"]): r["at"] for r in grouping.ranked(df, ["g", "v"], "at", within=["i"]).collect()}
        assert got == {(g, i): at for at, (g, v, i) in enumerate(sorted(rows))}
    assert grouping.ranked(df.limit(0), ["g"], "at").collect() == []


def test_medians_of_far_apart_values(spark):
    values = {"a": [1e-300, 1e300, -1e300, 5.0], "b": [0.1 + 1e-16 * i for i in range(9)], "c": [2.0] * 5 + [3.0] * 5}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: r["median_score"] for r in grouping.score_summary(df, ["g"], "v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in values.items()}


def test_numbered_equals_sorting(spark):
    rows = [(g, int(abs(v)) % 4, i) for g, v, i in skewed(3000, 3)]
    df = spark.createDataFrame(rows, "g string, v int, i long")
    got = {(r["g"], r["i"]): r["pos"] for r in grouping.numbered(df, ["g"], ["v"], "i", "pos", width=64).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for pos, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[(g, r[2])] = pos
    assert got == want


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, t string")
    assert {tuple(r) for r in grouping.first_by(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}
    assert {tuple(r) for r in grouping.last_by(df, ["k"], ["o"]).collect()} == {("a", 2, "x"), ("b", 5, "z")}
    pairs = df.select("k", "o")
    assert {tuple(r) for r in grouping.first_by(pairs, ["k"], ["o"]).collect()} == {("a", 1), ("b", 5)}


def test_salted_join_equals_join(spark):
    rows = spark.createDataFrame(skewed(500, 4), "g string, v double, i long")
    lookup = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("g") != "g1")
    for how in ("inner", "left", "left_semi"):
        plain = sorted(map(tuple, rows.join(lookup, ["g"], how).select("i").collect()))
        salted = grouping.salted_join(rows, lookup, ["g"], ["i"], how)
        assert sorted(map(tuple, salted.select("i").collect())) == plain

import random

import pytest

from rubricon.operators import containment
from rubricon.operators.containment import contained


def brute_force(needles, haystacks):
    return {(k, n, h) for k, n in needles for j, h in haystacks if k == j and n and n in h}


def check(spark, needles, haystacks):
    n = spark.createDataFrame(sorted(needles), "k string, needle string")
    h = spark.createDataFrame(sorted(haystacks), "k string, haystack string")
    got = [tuple(r) for r in contained(n, h, ["k"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force(needles, haystacks)
    return got


@pytest.mark.parametrize("few", [0, 16])
def test_equals_comparing_all(spark, monkeypatch, few):
    """Needles of every size class, few letters, so that grams repeat within texts and between them."""
    monkeypatch.setattr(containment, "FEW", few)
    rnd = random.Random(3)
    text = lambda n, letters="abc": "".join(rnd.choice(letters) for _ in range(n))
    haystacks = {(rnd.choice("xy"), text(rnd.randrange(60))) for _ in range(150)}
    haystacks |= {("few", text(20)) for _ in range(9)} | {("x", text(30, "aé😀")) for _ in range(20)}
    needles = {(rnd.choice("xyz"), text(rnd.randrange(6))) for _ in range(60)}
    for k, h in rnd.sample(sorted(haystacks), 120):
        at = rnd.randrange(len(h) + 1)
        needles.add((k, h[at : at + rnd.randrange(1, 40)]))
    needles |= {(k, n + "a") for k, n in rnd.sample(sorted(needles), 40)}
    assert len(check(spark, needles, haystacks)) > 300


def test_no_needles_and_no_haystacks(spark):
    none = spark.createDataFrame([], "needle string"), spark.createDataFrame([], "haystack string")
    some = spark.createDataFrame([("a",), ("",)], "needle string"), spark.createDataFrame([("abc",)], "haystack string")
    assert contained(none[0], some[1]).collect() == []
    assert contained(some[0], none[1]).collect() == []
    assert [tuple(r) for r in contained(*some).collect()] == [("a", "abc")]


def test_long_repetitive_text(spark, monkeypatch):
    monkeypatch.setattr(containment, "FEW", 0)
    h = "ab" * 30_000 + "the end of it all, at last" + "ba" * 30_000
    check(spark, {("k", "the end of it all, at"), ("k", "ab" * 20_000), ("k", "ab" * 20_000 + "c"), ("k", "l, a")}, {("k", h), ("k", "ab")})

import math
import random
from collections import Counter, defaultdict

import pytest

from rubricon.llm import mixing
from rubricon.llm.queries import op12_mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes by source; the share of all words that every source is to have."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {s: 0.0 for s in order}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        shared = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / shared for s in order}
        over = {s for s in order if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def slow_rate(docs, target, most=3):
    """size -> rate for one source, by bisection of its multiplier."""
    total = sum(docs)
    if target >= most * total:
        return {z: most for z in docs}
    typical = sum(z * z for z in docs) / total
    rate = lambda m, z: min(most, math.exp(min(m * z / typical, 5)))
    low, high = -1e6, 1e6
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if sum(z * rate(m, z) for z in docs) < target else (low, m)
    return {z: rate(low, z) for z in docs}


def check(rows, got, loose=0.5):
    """rows: (id, size, source)."""
    by = defaultdict(list)
    for _, z, s in rows:
        by[s].append(z)
    target = slow_targets({s: sum(z) for s, z in by.items()}) if sum(z for _, z, _ in rows) else dict.fromkeys(by, 0)
    rates = {s: slow_rate([z for z in by[s] if z], target[s]) for s in by if sum(by[s])}
    assert len(got) == len(rows)
    want = Counter((i, z, sum(by[s]), round(target[s], 6)) for i, z, s in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    taken, source = Counter(), {(i, z, sum(by[s])): s for i, z, s in rows}
    for r in got:
        s = source[r.doc_id, r.size, r.source_size]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        if r.size:
            assert r.rate == pytest.approx(rates[s][r.size], rel=1e-4, abs=1e-4)
            assert abs(r.copies - r.rate) < 2
        taken[s] += r.taken
    for s in by:
        # Rounding hands on what is left to smaller texts; the last ones leave less than their size.
        assert abs(taken[s] - target[s]) <= max(loose * min((z for z in by[s] if z), default=0) + 1, 0.001 * target[s])


def corpus(seed, n, sources):
    rng = random.Random(seed)
    return [(i, int(rng.paretovariate(0.8) * 3) % 4000, rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed, n, sources", [(1, 900, ["a", "b", "c", None]), (2, 1500, ["s1", "s2"] * 9 + ["s10", "z"]), (3, 300, ["x"])])
def test_equals_bisection(spark, seed, n, sources):
    rows = corpus(seed, n, sources)
    docs = spark.createDataFrame([(i, "w " * z, s, "x") for i, z, s in rows], "doc_id long, text string, source string, size string")
    got = mixing.mixed(docs).collect()
    check(rows, got)
    again = mixing.mixed(docs.repartition(13)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_targets_of_small_sources_stop(spark):
    rows = [(i, 10, "a") for i in range(3)] + [(9 + i, 10, "b") for i in range(50)] + [(99 + i, 7, "c") for i in range(9)]
    docs = spark.createDataFrame([(i, "w " * z, s) for i, z, s in rows], "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    assert {r.target for r in got if r.size == 10 and r.source_size == 30} == {90.0}
    assert all(r.copies == 3 for r in got if r.source_size == 30)
    check(rows, got)


def test_odd_rows(spark, documents, odd_rows):
    got = mixing.mixed(documents(odd_rows), source_col="text2").collect()
    sized = [(i, len((t or "").encode().split()), None) for i, t in odd_rows]
    # Three long texts hold nearly all words of one source.
    check(sized, got)
    assert all(r.target == r.source_size for r in got)


def test_no_words_and_no_rows(documents):
    rows = mixing.mixed(documents([(1, None), (2, " "), (None, "")]), source_col="id").collect()
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in rows) == [(0, 0, 0.0, 0)] * 3
    assert mixing.mixed(documents([]), source_col="id").collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = op12_mixing(spark, folder)
    assert [(c, t) for c, t in got.dtypes] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    by = {r.doc_id: r for r in got.collect()}
    sizes, taken = Counter(), Counter()
    for d in docs:
        assert by[d.doc_id].size == len((d.text or "").encode().split())
        sizes[d.source] += by[d.doc_id].size
        taken[d.source] += by[d.doc_id].taken
        assert by[d.doc_id].taken <= 3 * by[d.doc_id].size
    target = slow_targets(sizes)
    for d in docs:
        assert by[d.doc_id].target == pytest.approx(target[d.source])
        assert by[d.doc_id].source_size == sizes[d.source]
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] for s in sizes)

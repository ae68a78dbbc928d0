import os
import random

import numpy as np
import pytest

import corpus_pipeline
from rubricon import session
from rubricon.llm import jaccard


def true_sets(rows, words=5):
    out = []
    for _, t in rows:
        parts = (t or "").encode().lower().split()
        out.append({tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set())
    return out


def true_groups(rows):
    """Components over all pairs whose real shingle sets have a similarity of 0.8 or more."""
    sets = true_sets(rows)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    rank = lambda i: -float("inf") if i is None else i
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g), key=rank) for g in set(group)}
    return sorted(((rows[k][0], least[group[k]]) for k in range(len(rows))), key=str)


def got(df):
    return sorted(((r.doc_id, r.component_id) for r in df.collect()), key=str)


def edited(seed, n, bases, most):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(9999)}" for _ in range(120)] for _ in range(bases)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(most)):
            words[rng.randrange(120)] = f"New{rng.randrange(99)}"
        rows.append((i * 3 - 50, " ".join(words)))
    return rows


@pytest.mark.parametrize("bases, most", [(20, 9), (2, 7)])
def test_groups(documents, bases, most):
    rows = edited(bases, 150, bases, most)
    assert got(jaccard.near_groups(documents(rows))) == true_groups(rows)


def test_group_of_many_near_copies(documents):
    """Copies so far from each other that a hub alone does not link all of them."""
    rows = edited(4, 400, 1, 14)
    assert got(jaccard.near_groups(documents(rows))) == true_groups(rows)


def test_repeated_ids(documents):
    rows = edited(6, 60, 3, 6)
    rows += [(rows[0][0], rows[5][1]), rows[7], rows[7], (None, rows[2][1]), (None, "other")]
    assert got(jaccard.near_groups(documents(rows))) == true_groups(rows)


def test_cells_bound_the_difference():
    rng = random.Random(2)
    for _ in range(50):
        pool = np.unique(np.array([rng.getrandbits(64) for _ in range(900)], np.uint64))
        a, b = (np.sort(np.array(rng.sample(pool.tolist(), rng.randrange(1, 800)), np.uint64)) for _ in range(2))
        differ = len(np.setxor1d(a, b))
        assert jaccard.cells_differ(jaccard.cells(a), jaccard.cells(b)) <= differ
        assert jaccard.cells_differ(jaccard.cells(a), jaccard.cells(a)) == 0
        assert np.bitwise_count(jaccard.parities(a) ^ jaccard.parities(b)).sum() <= differ


def test_nothing_stays_in_scratch(spark, documents):
    """All but small tables of the answer are gone when it is there."""
    folder = session.shared_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    count = lambda: sum("scratch" in d for d in os.listdir(folder)) if os.path.isdir(folder) else 0
    before = count()
    jaccard.near_groups(documents(edited(1, 20, 2, 3)))
    assert count() == before


def test_odd_rows(documents, odd_rows):
    assert got(jaccard.near_groups(documents(odd_rows))) == true_groups(odd_rows)


def test_empty_table(documents):
    assert jaccard.near_groups(documents([])).collect() == []


def pair(share):
    """Two texts of 104 words, and so 100 shingles, each; the second has another end."""
    words = [f"v{i}" for i in range(104)]
    same = round(200 * share / (1 + share))
    return [(1, " ".join(words)), (2, " ".join(words[: same + 4] + [f"z{i}" for i in range(100 - same)]))]


def test_pairs_of_documents_that_fingerprints_lose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    chosen = docs.where("doc_id in (4, 2540, 205, 1, 9622)")
    kept = corpus_pipeline.near_dedup(spark, chosen, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_pairs_of_documents_below_the_limit_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for ids in [(4, 7413), (1, 5323), (0, 2892)]:
        kept = corpus_pipeline.near_dedup(spark, docs.where(f"doc_id in {ids}"), "")
        assert sorted(r.doc_id for r in kept.collect()) == list(ids)


def test_both_sides_of_the_limit(spark, documents):
    assert got(jaccard.near_groups(documents(pair(0.8)))) == [(1, 1), (2, 1)] == true_groups(pair(0.8))
    assert got(jaccard.near_groups(documents(pair(0.78)))) == [(1, 1), (2, 2)] == true_groups(pair(0.78))

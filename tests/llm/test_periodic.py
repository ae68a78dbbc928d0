import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rubricon.llm import periodic
from rubricon.llm.queries import op13_periodic


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[: len(w) - p])


def brute_force(w, least=24):
    """(start, length, period) of all runs, by the definition."""
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q) and smallest_period(w[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w, least=24):
    return [(s, e - s, q) for s, e, q in periodic.runs(np.array(w, np.int64)) if e - s >= least]


def nested(rng, depth):
    """Repetitions inside repetitions, with cut ends and a few changed words."""
    w = [rng.randrange(3) for _ in range(rng.randint(1, 5))]
    for _ in range(depth):
        w = w * rng.randint(1, 5)
        w = w[rng.randrange(2) : len(w) - rng.randrange(2)] + [rng.randrange(3) for _ in range(rng.randrange(4))]
        if rng.random() < 0.4 and w:
            w[rng.randrange(len(w))] = rng.randrange(4)
        w = w[:400] or [0]
    return w


@pytest.mark.parametrize("seed", range(60))
def test_nested_repetitions(seed):
    w = nested(random.Random(seed), 4)
    assert found(w) == brute_force(w)
    assert found(w, 1) == brute_force(w, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_any_sequence(w):
    assert found(w, 1) == brute_force(w, 1)


@pytest.mark.parametrize("q", [7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100])
def test_periods_around_the_scales(q):
    rng = random.Random(q)
    unit = [rng.randrange(2) for _ in range(q)]
    for extra in (-1, 0, 1, q // 2):
        w = [5, 6] + (unit * 5)[: 3 * q + extra] + [7, 8, 9]
        assert found(w) == brute_force(w)


def test_a_period_of_mostly_one_word():
    """The unit itself is highly periodic, so that small scales leave most of it out."""
    w = ([1] * 40 + [2]) * 4 + [1] * 7 + [3]
    assert found(w) == brute_force(w)


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert found(b, 1) == brute_force(b, 1)


def test_texts_do_not_touch():
    words = [b"a", b"b"] * 9
    assert periodic.runs_of_texts([words, words, [], [b"b"] * 30, words], 24) == [[], [], [], [(0, 30, 1)], []]


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(20, "la " * 50), (21, "a b c " * 30 + "x " + "y z " * 20)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.detected(documents(rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_force(w) if len(w) < 3000 else []
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(want, key=str)


def test_empty_table(documents):
    assert periodic.detected(documents([])).collect() == []


def test_query_equals_brute_force(spark, documents, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(260)))) for i in range(200)]
    rows += [(None, "x y z " * 20), (500, None), (501, ""), (502, "u v w " * 40), (502, "u v w " * 40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        h = crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = brute_force(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *shown, sha(listed), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = op13_periodic(spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert {d for _, d in got.dtypes[:6]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10

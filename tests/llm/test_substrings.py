import random
import re

import pytest

from rubricon.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, width):
    """Every window in order of (id, start); rows that share id and text are one document."""
    rank = lambda r: -float("inf") if r[0] is None else r[0]
    seen, done = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}, key=rank):
        words = WORD.findall(t)
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        done[i, t] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return sorted(((i, *done[i, t or ""]) for i, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def repeated(seed, n, alphabet=40):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(alphabet)}é" for _ in range(k)]
    passages = [say(rng.randint(4, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else say(rng.randint(0, 30))
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(words)))
    return rows


@pytest.mark.parametrize("width, gram", [(20, 4), (8, 3), (3, 3)])
def test_equals_brute_force(documents, width, gram):
    rows = repeated(width, 120)
    assert got(substrings.kept_words(documents(rows), width, gram)) == brute_force(rows, width)


def test_hot_minimisers_are_dealt_by_window(documents, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_LEAST", 3)
    monkeypatch.setattr(substrings, "HOT_SHARE", 10**9)
    rows = repeated(77, 150, alphabet=8)
    assert got(substrings.kept_words(documents(rows), 10, 3)) == brute_force(rows, 10)


def test_a_full_filter_loses_nothing(documents, monkeypatch):
    monkeypatch.setattr(substrings, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(substrings, "BLOCK_BITS", 1 << 6)
    rows = repeated(5, 100)
    assert got(substrings.kept_words(documents(rows), 20)) == brute_force(rows, 20)


def test_odd_rows(documents, odd_rows):
    assert got(substrings.kept_words(documents(odd_rows))) == brute_force(odd_rows, 20)
    carried = substrings.kept_words(documents(odd_rows), carry=True).select("row.*")
    assert carried.columns == documents(odd_rows).columns and carried.count() == len(odd_rows)


def test_empty_table(documents):
    assert substrings.kept_words(documents([])).collect() == []

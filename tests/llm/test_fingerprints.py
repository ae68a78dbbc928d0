import random
from collections import Counter

import numpy as np
import pytest

from rubricon.llm import fingerprints


def jaccard(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_collision_rate_is_generalised_jaccard():
    rng, sampler = random.Random(9), fingerprints.Sampler()
    misses = []
    for trial in range(200):
        pool = [f"w{i}_{trial}" for i in range(60)]
        a = rng.choices(pool[:45], k=120)
        b = a[: rng.randint(0, 120)] + rng.choices(pool, k=60)
        x, y = sampler.fingerprints([" ".join(a), " ".join(b)])
        misses.append((x == y).mean() - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(misses)) < 0.02 and np.std(misses) < 0.09


def test_batches_and_kept_words_do_not_matter(monkeypatch):
    texts = ["a b c a", "", "c d e " * 9, "a b c a"]
    whole = fingerprints.Sampler().fingerprints(texts)
    monkeypatch.setattr(fingerprints.Sampler, "KEPT", 1)
    assert (np.stack([fingerprints.Sampler().fingerprints([t])[0] for t in texts]) == whole).all()


def test_blocks_of_words_give_the_same(monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(f"v{int(rng.paretovariate(0.4)) % 9000}" for _ in range(12_000)), "a b a"]
    whole = fingerprints.Sampler().fingerprints(texts)
    monkeypatch.setattr(fingerprints, "BLOCK_WORDS", 1)
    assert (fingerprints.Sampler().fingerprints(texts) == whole).all()


def check(rows, out):
    order = sorted(rows, key=lambda r: -float("inf") if r[0] is None else r[0], reverse=True)
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        want[i, len(t), t[: len(t) - half] + n[:half]] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited) for r in out) == want


@pytest.mark.parametrize("size", [1, 500])
def test_next_document(documents, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "GROUP_ROWS", size)
    rng = random.Random(10)
    rows = [(rng.randrange(10**12), " ".join(rng.choices("abcdefg", k=rng.randint(0, 20)))) for _ in range(80)] + [(-5, "é x"), (2**60, "far")]
    out = fingerprints.edited_pairs(documents(rows)).collect()
    check(rows, out)
    one = {r.doc_id: r for r in out}
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprinted(documents(rows)).collect()}
    assert all(one[i].fingerprint == plain[i] for i in plain)


def test_odd_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] != 9]
    check(rows, fingerprints.edited_pairs(documents(rows)).collect())
    assert len(fingerprints.edited_pairs(documents(odd_rows)).collect()) == len(odd_rows)


@pytest.mark.parametrize("rows", [[], [(3, "alone here")], [(None, None)]])
def test_few_rows(documents, rows):
    out = fingerprints.edited_pairs(documents(rows)).collect()
    assert len(out) == len(rows)
    assert all(r.near_next == 1 for r in out)

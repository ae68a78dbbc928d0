import random
import re
from collections import defaultdict

import numpy as np
import pytest

from rubricon.llm import exact


def brute_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), float("inf") if i is None else i, i))
    out = []
    for members in groups.values():
        keep = min(members)[2]
        out += [(i, keep, len(members), i == keep) for _, _, i in members]
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def test_perfect_hash_is_minimal_and_answers_for_all():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, flags = exact.build_hash(words)
    assert sorted(exact.slots_of(words, sizes, flags)) == list(range(5000))
    strangers = exact.slots_of(rng.integers(0, 2**63, (500, 4), dtype=np.uint64), sizes, flags)
    assert ((strangers >= -1) & (strangers < 5000)).all()


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_any_history_gives_the_same_groups(documents, share):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", ""]).join(rng.choices("abc", k=rng.randint(0, 4)))) for i in range(300)]
    assert got(exact.exact_groups(documents(rows), share)) == brute_force(rows)


def test_odd_rows(documents, odd_rows):
    assert got(exact.exact_groups(documents(odd_rows))) == brute_force(odd_rows)


def test_empty_table(documents):
    assert exact.exact_groups(documents([])).collect() == []


def test_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_KEYS", 20)
    rows = [(i, f"text {i % 130}") for i in range(400)]
    assert got(exact.exact_groups(documents(rows))) == brute_force(rows)

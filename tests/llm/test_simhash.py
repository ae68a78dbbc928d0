import random

import numpy as np
import pytest
import xxhash

from rubricon.llm import simhash


def slow_fingerprint(text, words):
    parts = [w for w in (text or "").encode().translate(simhash._LOWER).split()]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(ones))


def slow_groups(rows, max_bits, words=4, prints=1, total_bits=64):
    fps = [slow_fingerprint(t, words) for _, t in rows]
    all_fps = [[int(x) for x in simhash.fingerprint(t or "", words, prints)] for _, t in rows]
    assert fps == [x[0] for x in all_fps]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            bits = [(a ^ b).bit_count() for a, b in zip(all_fps[i], all_fps[j])]
            if min(bits) <= max_bits and sum(bits) <= total_bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    rank = lambda i: -float("inf") if i is None else i
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g), key=rank) for g in set(group)}
    return sorted(((rows[k][0], fps[k], least[group[k]]) for k in range(len(rows))), key=str)


def got(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


def near_texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(60)] = "New"
        rows.append((i * 3 - 50, " ".join(words)))
    return rows


@pytest.mark.parametrize("task_nodes", [1 << 14, 8])
@pytest.mark.parametrize("max_bits", [4, 7])
def test_groups(documents, monkeypatch, task_nodes, max_bits):
    monkeypatch.setattr(simhash, "TASK_NODES", task_nodes)
    rows = near_texts(task_nodes + max_bits, 150)
    assert got(simhash.near_groups(documents(rows), max_bits)) == slow_groups(rows, max_bits)


@pytest.mark.parametrize("task_nodes", [1 << 14, 8])
def test_several_prints(documents, monkeypatch, task_nodes):
    monkeypatch.setattr(simhash, "TASK_NODES", task_nodes)
    rows = near_texts(33, 150)
    assert got(simhash.near_groups(documents(rows), 6, 5, prints=3, total_bits=30)) == slow_groups(rows, 6, 5, 3, 30)


def test_odd_rows(documents, odd_rows):
    assert got(simhash.near_groups(documents(odd_rows))) == slow_groups(odd_rows, 4)


def test_empty_table(documents):
    assert simhash.near_groups(documents([])).collect() == []


@pytest.mark.parametrize("max_bits", [0, 2, 4, 7])
def test_walk_finds_what_all_pairs_find(max_bits):
    rng = np.random.default_rng(max_bits)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 12, 3), dtype=np.uint64), axis=2)
    keys = np.unique(np.concatenate([(centres[:, None] ^ flips).ravel(), rng.integers(0, 2**63, 400, dtype=np.uint64)]))
    slow, fast = simhash._Sets(len(keys)), simhash._Sets(len(keys))
    for i in range(len(keys)):
        near = np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= max_bits)
        slow.unite(np.full(len(near), i), near)
    for turn in (0, 16, 32, 48):
        turned = (keys << np.uint64(turn)) | (keys >> np.uint64(64 - turn)) if turn else keys
        order = np.argsort(turned)
        fast.unite(order, order[simhash.unions(turned[order], 0, 0, 0, max_bits)])
    assert (slow.least == fast.least).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "u long, v long")
    assert {(r.u, r.v) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}

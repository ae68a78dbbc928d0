import zlib
from collections import defaultdict

import pytest

from rubricon.llm import sharding


def placed(documents, rows, **more):
    df = sharding.balanced_shards(documents(rows), **more)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    return df.collect()


def check(rows, out, shards):
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((str(i), str(t)) for i, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    for s, found in slots.items():
        assert 0 <= s < shards and sorted(found) == list(range(len(found)))
    return sizes


def test_sizes_are_near_equal_and_equal_texts_stay_together(documents):
    rows = [(i, f"document {i % 700} " * (1 + i % 7)) for i in range(1500)]
    out = placed(documents, rows, shards=8)
    sizes = check(rows, out, 8)
    largest = max(len(t) for _, t in rows)
    ideal = sum(sizes.values()) / 8
    assert all(abs(s - ideal) <= 2 * largest for s in sizes.values())
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 7


def test_one_text_that_owns_most_rows_is_parted(documents):
    rows = [(i, "hot text") for i in range(900)] + [(i, f"other {i}") for i in range(900, 1200)]
    sizes = check(rows, placed(documents, rows, shards=8), 8)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_counts_bytes_below_every_splitter_exactly(documents):
    rows = [(i, "ä" * (zlib.crc32(str(i).encode()) % 300)) for i in range(400)]
    sizes = check(rows, placed(documents, rows, shards=5, probes=4), 5)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 601


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, None), (None, None)]])
def test_few_rows(documents, rows):
    check(rows, placed(documents, rows, shards=8), 8)


def test_odd_rows(documents, odd_rows):
    check(odd_rows, placed(documents, odd_rows, shards=3), 3)

"""SimHash near-duplicates by a self-join of binary tries.

Every text gets a fingerprint of 64 bits. The distinct fingerprints form a binary trie; pairs within
an error budget are found by walking two nodes of it together: each step reads one bit more on both
sides, adds up the bits that differ and gives the pair up as soon as they exceed the budget. A pair
that ends up with few leaves is compared outright.

The budget grows along the way. If two fingerprints differ in at most m bits, one of the four
rotations by 16 bits has at most m*j/4 of them (rounded down) in its first j blocks, for every j. So
four tries, one per rotation, are walked with the budget of the block reached, and nothing is lost.

The upper levels are dealt over the cluster: a pair of nodes at depth d whose prefixes are within
the first block's budget is a task, d growing with the number of fingerprints so that a task holds
some ten thousand. A task unites what it links and returns at most one link per fingerprint, never
the pairs of a dense group; node pairs that are united already are not walked again. Links of all
tasks are joined to components by alternating star contractions, each round written to shared
storage. Copies of a fingerprint are one leaf, and no text or group is gathered anywhere.

A text may have several independent fingerprints (``prints``). Two are then linked when any one pair
of them is within the error budget and all together within ``total_bits``: the first finds more of
the similar texts, the second keeps out unlike ones that are close in one fingerprint by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import id_of, shown_id, text_of
from rubricon.session import stored

BITS, BLOCK = 64, 16
TASK_NODES = 32_768
OUTRIGHT = 64
FRONTIER = 1 << 19
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, words: int = 4, prints: int = 1) -> np.ndarray:
    """Bitwise majority of the hashes of all word shingles, repeats included; 0 without a word.

    Further fingerprints take the hashes mixed anew."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(prints, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((prints, BITS), np.int64)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)
        for p in range(prints):
            if p:
                hashes = _mixed(hashes)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[p] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) + np.uint64(0x9E3779B97F4A7C15)


def fingerprinted(docs: DataFrame, words: int = 4, prints: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fps (the fingerprints as signed longs) and leaf (what tells them apart) of every row; null
    text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words, prints).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fps"])

    out = docs.select(id_of(id_col), text_of(text_col)).mapInArrow(run, "id long, fps array<long>")
    return out.withColumn("leaf", F.col("fps")[0] if prints == 1 else F.xxhash64("fps"))


def budget(depth: int, max_bits: int) -> int:
    """Differing bits allowed in the first ``depth`` bits of the right rotation."""
    return max_bits * -(-depth // BLOCK) * BLOCK // BITS


class _Sets:
    """Sets of positions that unions make grow; every position knows the least of its set."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.least[a], self.least[b]
            apart = a != b
            a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.least, b, a)
            while True:
                further = self.least[self.least]
                if np.array_equal(further, self.least):
                    break
                self.least = further


def unions(
    keys: np.ndarray, depth: int, split: int, errors: int, max_bits: int, prints: np.ndarray | None = None, total_bits: int = 0
) -> np.ndarray:
    """For the sorted keys of one task, the position of the least key each is linked with.

    ``split`` parts the keys into the two nodes walked together, which differ in ``errors`` bits of
    their ``depth`` first ones; with ``split`` 0 it is one node, walked with itself. ``prints`` has all
    fingerprints of each key, which may differ in ``total_bits`` together.
    """
    n = len(keys)
    sets = _Sets(n)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(keys[a] ^ keys[b]) <= max_bits
        a, b = a[near], b[near]
        if prints is not None:
            near = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64) <= total_bits
            a, b = a[near], b[near]
        sets.unite(a, b)

    for gap in (1, 2):  # neighbours in the order of keys, to have dense groups united early
        unite(np.arange(n - gap), np.arange(gap, n))
    first = [0, n, 0, n, 0] if not split else [0, split, split, n, errors]
    stack = [(depth, np.array([first], np.int64))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(level, part) for part in np.array_split(pairs, -(-len(pairs) // FRONTIER))]
            continue
        a0, a1, b0, b1, _ = pairs.T
        # Whole nodes of one set have nothing left to find.
        change = np.concatenate([[0], np.cumsum(sets.least[1:] != sets.least[:-1])])
        one = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (sets.least[a0] == sets.least[b0])
        pairs = pairs[~one]
        if not len(pairs):
            continue
        a0, a1, b0, b1, _ = pairs.T
        small = ((a1 - a0) * (b1 - b0) <= OUTRIGHT) | (level == BITS)
        _compare(pairs[small], unite)
        pairs = pairs[~small]
        if len(pairs):
            stack.append((level + 1, _step(keys, pairs, level, budget(level + 1, max_bits))))
    return sets.least


def _compare(pairs: np.ndarray, unite) -> None:
    """Every leaf of one node with every leaf of the other, some millions of pairs at a time."""
    a0, a1, b0, b1, _ = pairs.T
    sizes = (a1 - a0) * (b1 - b0)
    at = 0
    while at < len(pairs):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 22)) + at)
        n = sizes[at:upto]
        which = np.repeat(np.arange(at, upto), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[which]
        unite(a0[which] + inner // width, b0[which] + inner % width)
        at = upto


def _step(keys: np.ndarray, pairs: np.ndarray, level: int, allowed: int) -> np.ndarray:
    """Pairs of children, one bit further down, that are within the budget."""
    ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
    a0, a1, b0, b1, err = pairs.T
    am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
    same = a0 == b0
    out = [
        np.stack([a0, am, b0, bm, err], axis=1),
        np.stack([am, a1, bm, b1, err], axis=1),
        np.stack([a0, am, bm, b1, err + 1], axis=1),
        np.stack([am, a1, b0, bm, err + 1], axis=1)[~same],
    ]
    children = np.concatenate(out)
    return children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= allowed)]


def _task_links(max_bits: int, depth: int, total_bits: int | None):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, leaves = keys[order], part["leaf"].to_numpy(np.int64)[order]
        prints = None
        if total_bits is not None:
            prints = np.stack(part["fps"].to_list())[order].view(np.uint64)
        split, errors = 0, 0
        if depth:
            top = keys >> np.uint64(BITS - depth)
            errors = int(np.bitwise_count(top[0] ^ top[-1]))
            # A task of two nodes does not walk either with itself: another task does.
            split = int(np.searchsorted(top, top[-1])) if errors else 0
            if bool(part["cross"].iloc[0]) and not errors:
                keys = keys[:0]
        least = unions(keys, depth, split, errors, max_bits, prints, total_bits or 0) if len(keys) > 1 else np.arange(len(keys))
        moved = np.flatnonzero(least != np.arange(len(keys)))
        a, b = leaves[moved], leaves[least[moved]]
        return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    return run


def links(nodes: DataFrame, count: int, max_bits: int = 4, prints: int = 1, total_bits: int | None = None) -> DataFrame:
    """u > v: leaves that are linked, enough of them to connect every component.

    ``nodes`` has the distinct leaves (leaf, fps), ``count`` is their number.
    """
    depth = min(BLOCK, max(0, math.ceil(math.log2(max(1, count) / TASK_NODES))))
    flips = [m for e in range(1, budget(1, max_bits) + 1) for m in combinations(range(depth), e)]
    masks = [sum(1 << b for b in m) for m in flips]

    def turned(p: int, turn: int) -> Column:
        fp = F.col("fps")[p]
        key = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn)) if turn else fp
        return F.struct(F.lit(p * BITS + turn).alias("turn"), key.alias("key"))

    tries = F.explode(F.array(*[turned(p, turn) for p in range(prints) for turn in range(0, BITS, BLOCK)]))
    carried = ["leaf"] if total_bits is None else ["leaf", "fps"]
    dealt = nodes.select("leaf", "fps", tries.alias("_t")).select(*carried, "_t.turn", "_t.key")
    if depth:
        top = F.shiftrightunsigned("key", BITS - depth)
        # A pair of nodes is named by the smaller prefix and the mask of the bits that differ.
        dealt = dealt.withColumn("mask", F.explode(F.array(F.lit(0), *[F.lit(m) for m in masks])))
        dealt = dealt.withColumn("branch", F.least(top, top.bitwiseXOR(F.col("mask"))))
    else:
        dealt = dealt.withColumns({"mask": F.lit(0), "branch": F.lit(0)})
    dealt = dealt.withColumn("cross", F.col("mask") != 0)
    task = _task_links(max_bits, depth, total_bits)
    return dealt.groupBy("turn", "branch", "mask").applyInPandas(task, "u long, v long").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: every linked node and the least node of its component, from edges u > v.

    Alternates the two star contractions until nothing changes.
    """
    seen = None
    while True:
        edges = stored(edges, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges
        seen = state
        edges = _small_star(_large_star(edges))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def near_groups(
    docs: DataFrame,
    max_bits: int = 4,
    words: int = 4,
    prints: int = 1,
    total_bits: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest id reachable over links.

    Two rows are linked when their fingerprints differ in at most ``max_bits`` (up to 15) bits; with
    several ``prints``, when one of them does and all together differ in at most ``total_bits``. Texts
    without a word, null ones too, have the fingerprint zero and are linked like any others. A null id
    is smaller than all others. An empty table gives an empty one; other columns are not read.
    """
    rows = stored(fingerprinted(docs, words, prints, id_col, text_col), "fingerprints")
    nodes = stored(rows.groupBy("leaf").agg(F.min("id").alias("first"), F.first("fps").alias("fps")), "nodes")
    stars = components(links(nodes, nodes.count(), max_bits, prints, total_bits))
    rooted = nodes.join(stars.select(F.col("u").alias("leaf"), F.col("v").alias("root")), "leaf", "left")
    rooted = rooted.select("leaf", "first", F.coalesce("root", "leaf").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("leaf", "component")
    return rows.join(named, "leaf").select(
        shown_id("id").alias("doc_id"), F.col("fps")[0].alias("fp"), shown_id("component").alias("component_id")
    )

"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two texts are linked when the sets of their shingles have a similarity of at least num/den. Every link
is verified on the sets and no pair is missed. Pairs to verify come from three sides:

1. SimHash: texts whose fingerprints are within a few bits (``simhash.links``). They are found cheaply
   and are most of the links, but not all.
2. A prefix filter finds the rest. Shingles are put in one total order; if two sets are similar, their
   first n - ceil(n * num / den) + 1 shingles of n have one in common, so that texts meet in the buckets
   of these. The order puts the shingles that are common in a sample of the texts last, which keeps
   buckets small; any order gives the same result. Only shingles of several texts travel: all are
   counted first, without their texts, and the repeated ones held as a Bloom filter of bounded size,
   which may let others through. Every text of a bucket is compared with two of it, the hubs.
3. The links so far give components. Texts of a bucket that are still in different ones are compared.
   Two texts that have the same shingle before this one in their order meet in its bucket too, and are
   left to it: of a run of shared shingles only the first brings them together.

Before sets are read, a pair must pass what bounds its similarity from above: its sizes, the places of
the shared shingle, in the buckets of 3. the parities of both sets over cells of the hash range, which
differ in no more cells than the sets differ in shingles, and then the counts over finer cells, whose
differences add up to no more than that either. Intermediate tables are deleted when the components are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm import simhash
from rubricon.llm.common import id_of, shown_id, text_of
from rubricon.llm.simhash import _LOWER, components
from rubricon.llm.substrings import _filter, _passes
from rubricon.session import bounded_batches, scratch, stored

SAMPLE_ROWS = 10_000
COMMON = 1 << 16
CELL_MEAN = 4
PARITY_LONGS = 8
#: The bits of a shingle that are counted; fewer than all travel in fewer bytes.
COUNTED = (1 << 40) - 1


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted; a shorter text is one shingle."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, n))


def _leaf(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - 2**63


def cells(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each cell, a power of two of them, some CELL_MEAN a cell at most."""
    count = 1 << max(4, (len(s) // CELL_MEAN).bit_length())
    return np.bincount((s & np.uint64(count - 1)).astype(np.int64), minlength=count).astype(np.uint16)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of some cells is odd, as the bits of longs."""
    counts = np.bincount((s % np.uint64(PARITY_LONGS * 64)).astype(np.int64), minlength=PARITY_LONGS * 64)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def cells_differ(a: np.ndarray, b: np.ndarray) -> int:
    """By how many shingles two sets differ at least."""
    if len(a) < len(b):
        a, b = b, a
    a = a.reshape(-1, len(b)).sum(axis=0, dtype=np.int64)
    return int(np.abs(a - b).sum())


def _common(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that texts of a bounded sample share, sorted, and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = shingles(t.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["shingle"])

    text = text_of(text_col)
    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).select(text)
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1")
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    keys, n = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _shingled(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, leaf (hash of the set), n (its size), fp (SimHash fingerprint), prefix, cells and parities."""
    common, count = _common(docs, words, text_col)

    def one(text: str):
        s = shingles(text, words)
        n = len(s)
        rank = np.zeros(n, np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            rank = np.where(common[at] == s, count[at], 0)
        prefix = s[np.lexsort((s, rank))][: n - -(-n * num // den) + 1]
        return _leaf(s), n, int(simhash.fingerprint(text, words).view(np.int64)[0]), prefix.view(np.int64), cells(s).tobytes(), parities(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            found = zip(*[one(t.as_py()) for t in batch.column(1)]) if batch.num_rows else ((),) * 6
            columns = [batch.column(0), *map(pa.array, found, types)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "leaf", "n", "fp", "prefix", "cells", "odd"])

    out = docs.select(id_of(id_col), text_of(text_col))
    return out.mapInArrow(run, "id long, leaf long, n long, fp long, prefix array<long>, cells binary, odd array<long>")


def _proposed(rows: DataFrame, max_bits: int, put: Callable) -> DataFrame:
    """u > v: sets of texts whose fingerprints are equal or within the bits, one set for all that share
    a fingerprint being compared with the others and standing for them."""
    held = put(rows.select("fp", "leaf").distinct(), "fingerprints")
    first = held.groupBy("fp").agg(F.min("leaf").alias("first"))
    alike = held.join(first, "fp").where("leaf <> first").select(F.col("leaf").alias("u"), F.col("first").alias("v"))
    nodes = put(first.select(F.col("fp").alias("leaf"), F.array("fp").alias("fps"), "first"), "nodes")
    found = simhash.links(nodes.select("leaf", "fps"), nodes.count(), max_bits)
    named = lambda fp, name: nodes.select(F.col("leaf").alias(fp), F.col("first").alias(name))
    near = found.join(named("u", "a"), "u").join(named("v", "b"), "v")
    return alike.unionByName(near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _buckets(rows: DataFrame, put: Callable) -> DataFrame:
    """shingle, leaf, n, pos, before: the places of prefix shingles that several rows have, and of some
    others, with the shingle before in the order (zero before the first)."""
    listed = rows.select(F.explode("prefix").alias("m")).select(F.col("m").bitwiseAND(F.lit(COUNTED)).alias("m"))
    counts = listed.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    repeated = put(counts.where("n > 1").select("m"), "repeated")
    bits, filled = _filter(repeated, repeated.count())
    shared = rows.sparkSession.sparkContext.broadcast((bits, filled))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            sizes = prefix.value_lengths().to_numpy()
            flat = prefix.flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(_passes(flat.view(np.uint64) & np.uint64(COUNTED), *shared.value))
            leaf, n = (batch.column(i).to_numpy()[owner[kept]] for i in (0, 1))
            before = np.where(pos[kept] > 0, flat[kept - 1], 0) if len(kept) else kept
            columns = [flat[kept], leaf, n, pos[kept], before]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "leaf", "n", "pos", "before"])

    return rows.select("leaf", "n", "prefix").mapInArrow(run, "shingle long, leaf long, n long, pos long, before long")


def _may_reach(na: Column, nb: Column, rest: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes that share at most ``rest`` can be similar enough."""
    return (na * den >= num * nb) & (nb * den >= num * na) & (rest * (num + den) >= num * (na + nb))


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, put: Callable) -> DataFrame:
    """u > v: the pairs whose sets are similar, as a table of scratch."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("leaf")).distinct()
    held = rows.join(ends, "leaf", "left_semi").groupBy("leaf").agg(F.first("n").alias("n"), F.first("cells").alias("cells"), F.min("id").alias("id"))
    held = put(held, "held")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            pairs = zip(n.tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            read = lambda b: np.frombuffer(b, np.uint16)
            ok = [(m - cells_differ(read(a), read(b))) * (num + den) >= 2 * num * m for m, a, b in pairs]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    side = lambda end, suffix: held.select(F.col("leaf").alias(end), *[F.col(c).alias(c + suffix) for c in ("n", "cells")])
    na, nb = F.col("na"), F.col("nb")
    sized = pairs.join(held.select(F.col("leaf").alias("u"), F.col("n").alias("na")), "u")
    sized = sized.join(held.select(F.col("leaf").alias("v"), F.col("n").alias("nb")), "v")
    sized = sized.where(_may_reach(na, nb, F.least(na, nb), num, den)).select("u", "v")
    full = sized.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "na", "nb", "cellsa", "cellsb")
    pairs = put(full.mapInArrow(near, "u long, v long"), "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in batch.column(1)]
            leaf = pa.array([_leaf(s) for s in found], pa.int64())
            found = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([leaf, found], names=["leaf", "held"])
            yield out.filter(pc.equal(leaf, batch.column(0)))

    ends = pairs.select(F.explode(F.array("u", "v")).alias("leaf")).distinct()
    # Stored, its size is known, and a small one is broadcast: the texts then stay where they are.
    ids = put(held.join(ends, "leaf", "left_semi").select("leaf", F.col("id").alias("_id")), "ids")
    texts = docs.select(id_of(id_col).alias("_id"), text_of(text_col).alias("_text")).join(ids, "_id")
    # Rows that share an id may have other texts, or the same one again.
    sets = texts.select("leaf", "_text").mapInArrow(run, "leaf long, held array<long>").dropDuplicates(["leaf"])
    sets = put(sets, "sets")
    both = pairs.join(sets.select(F.col("leaf").alias("u"), F.col("held").alias("a")), "u")
    both = both.join(sets.select(F.col("leaf").alias("v"), F.col("held").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return put(both.where(shared * (num + den) >= num * (F.size("a") + F.size("b"))).select("u", "v"), "links")


def links(docs: DataFrame, rows: DataFrame, words: int, num: int, den: int, max_bits: int, id_col: str, text_col: str, put: Callable) -> DataFrame:
    """u > v: similar leaves, enough of them to connect every component."""
    verified = lambda pairs: _verified(pairs, docs, rows, words, num, den, id_col, text_col, put)
    held = put(_buckets(rows, put), "buckets")
    place = F.struct("leaf", "n", "pos")
    hubs = held.groupBy("shingle").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low.leaf <> high.leaf")
    met = held.join(hubs, "shingle").select("leaf", "n", "pos", F.explode(F.array("low", "high")).alias("hub"))
    # What a hub leaves out here is looked at below, so that it may be left out for any shared shingle.
    n, hub_n = F.col("n"), F.col("hub.n")
    rest = F.least(n - F.col("pos"), hub_n - F.col("hub.pos"))
    met = met.where((F.col("leaf") != F.col("hub.leaf")) & _may_reach(n, hub_n, rest, num, den))
    met = met.select(F.greatest("leaf", "hub.leaf").alias("u"), F.least("leaf", "hub.leaf").alias("v"))
    pairs = put(met.unionByName(_proposed(rows, max_bits, put)).distinct(), "pairs")
    edges = verified(pairs)

    roots = components(edges).select(F.col("u").alias("leaf"), F.col("v").alias("root"))
    at = held.join(roots, "leaf", "left").select("shingle", "leaf", "n", "pos", "before", F.coalesce("root", "leaf").alias("root"))
    at = put(at, "rooted")
    # A bucket whose texts are all in one component has nothing left to find.
    open_ = at.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    at = put(at.join(open_, "shingle", "left_semi"), "open")
    odd = rows.join(at.select("leaf").distinct(), "leaf", "left_semi").groupBy("leaf").agg(F.first("odd").alias("odd"))
    at = put(at.join(odd, "leaf"), "open")
    a, b = at.alias("a"), at.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    # The first shingle that both have, in their order, bounds what they share by what follows it.
    rest = F.least(na - F.col("a.pos"), nb - F.col("b.pos"))
    differ = sum(F.bit_count(F.col("a.odd")[i].bitwiseXOR(F.col("b.odd")[i])) for i in range(PARITY_LONGS))
    near = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.leaf") > F.col("b.leaf"))
        & (F.col("a.root") != F.col("b.root"))
        & ~((F.col("a.pos") > 0) & (F.col("b.pos") > 0) & (F.col("a.before") == F.col("b.before")))
        & _may_reach(na, nb, rest, num, den)
        & ((na + nb - differ) * (num + den) >= 2 * num * (na + nb))
    )
    further = a.join(b, near).select(F.col("a.leaf").alias("u"), F.col("b.leaf").alias("v")).distinct()
    further = put(further.join(pairs, ["u", "v"], "left_anti"), "further")
    return edges.unionByName(verified(further))


def near_groups(
    docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and component_id of every row: the smallest id reachable over links.

    Two rows are linked when the Jaccard similarity of their sets of shingles is at least num/den;
    ``max_bits``, the reach of the fingerprints, decides how links are found and not which. Texts
    without a word, null ones too, have the empty set and are linked with each other only. A null id is
    smaller than all others. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as put:
        rows = put(_shingled(docs, words, num, den, id_col, text_col), "shingles")
        stars = components(links(docs, rows, words, num, den, max_bits, id_col, text_col, put))
        nodes = rows.groupBy("leaf").agg(F.min("id").alias("first"))
        rooted = nodes.join(stars.select(F.col("u").alias("leaf"), F.col("v").alias("root")), "leaf", "left")
        rooted = rooted.select("leaf", "first", F.coalesce("root", "leaf").alias("root"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component")), "root").select("leaf", "component")
        found = stored(rows.select("id", "leaf").join(named, "leaf").select("id", "component"), "near")
    return found.select(shown_id("id").alias("doc_id"), shown_id("component").alias("component_id"))

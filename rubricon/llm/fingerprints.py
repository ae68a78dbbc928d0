"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, their weights how often they occur. For sample k and term x of
weight w, draws that depend on (k, x) alone, r and c from Gamma(2, 1) and b from the unit interval,
give

    t = floor(log w / r + b),   log a = log c - r (t - b) - r

and the sample is the (x, t) of the term with the least a. Two texts share a sample with the
probability of their generalised Jaccard similarity, sum of least over sum of greatest weights.

A term that occurs once has t = 0 and an ``a`` of its own, which is kept for the words that a worker
met first; words of a slice of texts are drawn once for all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import LOWEST, id_of, shown_id, text_of

SAMPLES = 64
CELLS = 1 << 16
GROUP_ROWS = 500
_SLICE_CHARS = 1 << 19
BLOCK_WORDS = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, log c and b (terms x samples) for term hashes."""
    k = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    base = _mixed(terms[:, None] + k[None, :])
    scale = np.float32(2.0**-32)

    def pair(salt: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(base + np.uint64(salt))
        high, low = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
        return (high.astype(np.float32) + np.float32(0.5)) * scale, (low.astype(np.float32) + np.float32(0.5)) * scale

    (a, b), (c, d) = pair(0x5851F42D4C957F2D), pair(0x14057B7EF767814F)
    unit = (base >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
    return -np.log(a) - np.log(b), np.log(-np.log(c) - np.log(d)), unit


class Sampler:
    """Fingerprints of texts, with the words kept that it met first."""

    KEPT = 200_000

    def __init__(self):
        self.row: dict[bytes, int] = {}
        self.single = np.empty((1 << 12, SAMPLES), np.float32)

    def _single(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """``a`` of every word for weight 1."""
        out = np.empty((len(words), SAMPLES), np.float32)
        rows = np.fromiter((self.row.get(w, -1) for w in words), np.int64, len(words))
        known = rows >= 0
        out[known] = self.single[rows[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 4096):
            at = new[i : i + 4096]
            r, c, b = draws(hashes[at])
            out[at] = c + r * b - r
        for i in new[: max(0, self.KEPT - len(self.row))]:
            if len(self.row) == len(self.single):
                self.single = np.concatenate([self.single, np.empty_like(self.single)])
            self.single[len(self.row)] = out[i]
            self.row[words[i]] = len(self.row)
        return out

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """One row of samples for each text; an empty text has zeros."""
        counts = [Counter(t.encode().split()) for t in texts]
        out = np.zeros((len(texts), SAMPLES), np.uint32)
        for i, c in enumerate(counts):
            if len(c) > BLOCK_WORDS:
                out[i] = _by_blocks(c)
                counts[i] = Counter()
        words = list(dict.fromkeys(chain.from_iterable(counts)))
        place = dict(zip(words, range(len(words))))
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=9), words), np.uint64, len(words))
        single = self._single(words, hashes)
        at = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in counts]
        weights = [np.fromiter(c.values(), np.int64, len(c)) for c in counts]
        # Words that occur more than once in some text need their draws themselves.
        often = np.unique(np.concatenate([a[w > 1] for a, w in zip(at, weights)] or [np.zeros(0, np.int64)]))
        drawn = np.full(len(words), -1)
        drawn[often] = np.arange(len(often))
        r, logc, b = draws(hashes[often])
        for i, (terms, weight) in enumerate(zip(at, weights)):
            if not len(terms):
                continue
            a = single[terms]
            steps = np.zeros((len(terms), 1), np.float32)
            several = np.flatnonzero(weight > 1)
            if len(several):
                d = drawn[terms[several]]
                t = np.floor(np.log(weight[several]).astype(np.float32)[:, None] / r[d] + b[d])
                a[several] = logc[d] - r[d] * (t - b[d]) - r[d]
                steps = np.zeros(a.shape, np.float32)
                steps[several] = t
            best = a.argmin(axis=0)
            t = np.take_along_axis(steps, best[None, :], axis=0)[0] if steps.shape[1] > 1 else np.zeros(SAMPLES)
            out[i] = _packed(hashes[terms[best]], t)
        return out


def _packed(terms: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Samples (term hash, t) in 32 bits each, never 0."""
    with np.errstate(over="ignore"):
        mixed = _mixed(terms + steps.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _by_blocks(counts: Counter) -> np.ndarray:
    """The samples of one text with very many words, a block of them at a time."""
    words = list(counts)
    least = np.full(SAMPLES, np.inf, np.float32)
    terms, steps = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    for i in range(0, len(words), 4096):
        part = words[i : i + 4096]
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=9), part), np.uint64, len(part))
        weight = np.log(np.fromiter((counts[w] for w in part), np.int64, len(part))).astype(np.float32)
        r, logc, b = draws(hashes)
        t = np.floor(weight[:, None] / r + b)
        a = logc - r * (t - b) - r
        best = a.argmin(axis=0)
        found = np.take_along_axis(a, best[None, :], axis=0)[0]
        less = found < least
        least[less] = found[less]
        terms[less] = hashes[best[less]]
        steps[less] = t[best[less], np.flatnonzero(less)]
    return _packed(terms, steps)


def hexed(samples: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in samples]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    """One sampler per worker process."""
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal, eight digits a sample) of every text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for texts in _sliced(batch.column(1).to_pylist()):
                found += hexed(sampler().fingerprints(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    out = docs.select(id_of(id_col).alias("id"), text_of(text_col)).mapInArrow(run, "id long, fingerprint string")
    return out.select(shown_id("id").alias("doc_id"), "fingerprint")


def _sliced(texts: list) -> Iterator[list]:
    """Runs of whole texts of about a bounded number of characters."""
    held, part = 0, []
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= _SLICE_CHARS:
            yield part
            held, part = 0, []
    if part:
        yield part


def in_descending_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, grp, guest: rows dealt to groups of neighbouring ids, each followed by the row that
    comes next in the circle of descending ids as its guest.

    Groups are runs of equal-width cells of the id range, at most CELLS of them, so that the driver
    needs the cells' row counts and the groups' highest ids only. The text moves once.
    """
    rows = docs.select(id_of(id_col).alias("id"), text_of(text_col).alias("text"))
    known = F.col("id") != LOWEST
    low, high = rows.agg(F.min(F.when(known, F.col("id"))), F.max(F.when(known, F.col("id")))).first()
    low, high = low or 0, high or 0
    width = (high - low) // (CELLS - 2) + 1
    # Cell 1 holds null ids, the lowest of all.
    cell = F.when(known, F.expr(f"cast((id - {low}L) div {width}L as int)") + 2).otherwise(1)
    counts = {r["c"]: r["count"] for r in rows.groupBy(cell.alias("c")).count().collect()}
    group_of, group, held = [0] * (max(counts, default=1) + 1), 0, 0
    for c in range(len(group_of)):
        if held >= GROUP_ROWS:
            group, held = group + 1, 0
        group_of[c] = group
        held += counts.get(c, 0)
    grp = F.element_at(F.lit(np.array(group_of, np.int32)), cell + 1)
    heads = {r["g"]: r["h"] for r in rows.groupBy(grp.alias("g")).agg(F.max("id").alias("h")).collect()}
    present = sorted(heads)
    # Descending order leaves a group for the one below it; the lowest leads back to the highest.
    before = {g: present[(i + 1) % len(present)] for i, g in enumerate(present)}
    n = max(present, default=0) + 1
    head_of = F.element_at(F.lit(np.array([heads.get(g, 0) for g in range(n)], np.int64)), F.col("grp") + 1)
    guest_of = F.element_at(F.lit(np.array([before.get(g, 0) for g in range(n)], np.int32)), F.col("grp") + 1)
    at = lambda g, guest: F.struct(g.alias("grp"), F.lit(guest).alias("guest"))
    own = at(F.col("grp"), False)
    dealt = rows.withColumn("grp", grp).withColumn(
        "at", F.explode(F.when(F.col("id") == head_of, F.array(own, at(guest_of, True))).otherwise(F.array(own)))
    )
    return dealt.select("id", "text", "at.grp", "at.guest")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    Returns doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last half, rounded down, replaced by as many characters from
    the start of the next document's text, or all of it; next is the document with the next smaller
    id, after the last the first. Null text is empty; two empty texts are alike. Null ids come last,
    and rows that share an id are ordered by a hash of the text.
    """
    dealt = in_descending_groups(docs, id_col, text_col)
    ordered = dealt.repartition("grp").sortWithinPartitions(
        "grp", "guest", F.desc("id"), F.xxhash64("text")
    )
    schema = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = ordered.select("id", "text", "grp", "guest").mapInArrow(_with_next, schema)
    return out.withColumn("id", shown_id("id")).withColumnRenamed("id", "doc_id")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each group's guest last: every row but a guest looks at the row after it."""
    held: list[tuple] = []  # rows not yet answered; the last one waits for its next
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(1)):
            key, grp, guest, text = row
            text = text.as_py()
            if guest and held and held[-1][3] and held[-1][1] == grp:
                continue  # a group needs one guest
            held.append((key, grp, text, guest))
            size += len(text)
            if size >= _SLICE_CHARS:
                yield _answered(held)
                held, size = held[-1:], len(held[-1][2])
    if held:
        yield _answered(held)


def _answered(rows: list[tuple]) -> pa.RecordBatch:
    """Answers for all rows but guests and the last one."""
    samples = sampler()
    own = [i for i in range(len(rows) - 1) if not rows[i][3]]
    texts = [r[2] for r in rows]
    edited = []
    for i in own:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    both = samples.fingerprints(texts + edited)
    plain, changed = both[: len(texts)], both[len(texts) :]
    at = np.array(own, np.int64)
    columns = [
        pa.array([rows[i][0] for i in own], pa.int64()),
        pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array(edited, pa.string()),
        pa.array(hexed(plain[at]), pa.string()),
        pa.array(hexed(changed), pa.string()),
        pa.array(likeness(plain[at], changed), pa.float64()),
        pa.array(likeness(plain[at], plain[np.minimum(at + 1, len(rows) - 1)]), pa.float64()),
    ]
    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays(columns, names=names)

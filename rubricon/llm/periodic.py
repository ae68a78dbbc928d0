"""Runs: passages of a text that repeat with a period at least three times.

Words become numbers, and the texts of a batch one sequence in which a number of its own parts two
texts, so that no repetition crosses a border. A run is a longest stretch with a smallest period q, at
least 3 q long. Periods up to 7 are read off the sequence by comparing it with itself. For the others
the scales t = 4, 8, 16, ... each find the periods from 2 t to 4 t - 1:

* A position is selected when the least hash among the t + 1 windows of t words that start at it and
  after it belongs to the first or the last of them. Selection depends on the 2 t words from there on
  only, so positions with equal contexts are selected together (a string synchronising set).
* Windows inside a run of a period up to t / 3, which smaller scales and the comparison have found,
  are left out; without them two equal contexts start more than t / 3 apart, which bounds the pairs.
* Two selected positions with equal contexts whose distance d is of the scale propose d as a period.
  The stretch around them that agrees with itself at distance d is a run if it is 2 d long or longer.

No run is missed: its first period has a selected position, else Fine and Wilf's theorem would give it
a smaller period, and the context one period later is equal. Proposals are compared word by word, so
that the hashes decide nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import slices, text_of

COMPARED = 7
_FIRST_SCALE = 4
_NONE = np.uint64(2**64 - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _joined(names: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    return _mixed(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + names[width:])


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches of true values that are at least so long."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    long = last - first >= least
    return first[long], last[long]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many items agree before the first that does not."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = end, 2 * step
    return n


def _selected(names: np.ndarray, t: int, periodic: list[tuple[int, int]]) -> np.ndarray:
    """The synchronising positions of a scale; ``names`` are the hashes of windows of t words."""
    if periodic:
        edge = np.zeros(len(names) + 1, np.int64)
        first, last = np.array(periodic, np.int64).T
        np.add.at(edge, first, 1)
        np.add.at(edge, last - t + 1, -1)
        names = np.where(np.cumsum(edge[:-1]) > 0, _NONE, names)
    count = len(names) - t
    least, width = names, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:count], names[t:])
    return np.flatnonzero((least != _NONE) & ((least == names[:count]) | (least == names[t:])))


def _proposed(at: np.ndarray, context: np.ndarray, t: int) -> list[tuple[int, int]]:
    """(period, position) of pairs of equal context whose distance belongs to the scale, in order."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    found = [np.zeros((0, 2), np.int64)]
    for k in range(1, len(at)):
        apart = at[k:] - at[:-k]
        near = (context[k:] == context[:-k]) & (apart < 4 * t)
        if not near.any():
            break
        near &= apart >= 2 * t
        found.append(np.stack([apart[near], at[:-k][near]], axis=1))
    pairs = np.concatenate(found)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist()


def runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least three periods, in order of start, then period.

    ``longest`` bounds the length of a run, where the caller knows one.
    """
    ids = np.ascontiguousarray(ids, np.int64)
    longest = len(ids) if longest is None else min(longest, len(ids))
    found: dict[tuple[int, int], int] = {}  # a stretch keeps its smallest period, which comes first
    for q in range(1, min(COMPARED, longest // 3) + 1):
        for first, last in zip(*(x.tolist() for x in _stretches(ids[:-q] == ids[q:], 2 * q))):
            found.setdefault((first, last + q), q)
    names, width = _mixed(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
    t = _FIRST_SCALE
    while 6 * t <= longest:
        while width < t:
            names, width = _joined(names, width), 2 * width
        contexts = _joined(names, t)
        at = _selected(names, t, [(s, e) for (s, e), q in found.items() if 3 * q <= t <= e - s])
        period, reach = 0, 0
        for q, i in _proposed(at, contexts[at], t):
            if q == period and i < reach:
                continue  # the stretch around it has been looked at
            period, reach = q, i + _agree(ids[i:], ids[i + q :])
            first = i - _agree(ids[:i][::-1], ids[: i + q][::-1])
            if reach - first >= 2 * q:
                found.setdefault((first, reach + q), q)
        t *= 2
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every list of words that are at least so long."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = pd.factorize(np.array([w for t in texts for w in t], object))[0] if sizes.sum() else np.zeros(0, np.int64)
    # Each text is followed by a number that occurs nowhere else.
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.arange(-1, -len(ids) - len(texts) - 1, -1)
    whole[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), sizes)] = ids
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in runs(whole, int(sizes.max(initial=0))):
        if e - s >= least:
            k = int(np.searchsorted(starts, s, "right")) - 1
            out[k].append((s - int(starts[k]), e - s, q))
    return out


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for s, n, q in found:
        gone[s + q : s + n] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone)])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _detect(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for first, last in slices(texts):
            words = [t.split() for t in texts[first:last]]
            found = runs_of_texts(words, least)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in one] for one in found]
            kept = pa.array(map(_collapsed, words, found), pa.binary()).cast(pa.string())
            columns = [batch.column(0).slice(first, last - first), pa.array(map(len, words), pa.int64()), pa.array(rows, _RUNS), kept]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def detected(docs: DataFrame, least: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period) and collapsed of
    every row: the text without the repetitions, each run's first period kept, words joined by a space.

    A run has at least ``least`` words and three periods. Null and empty texts have no words. Rows are
    independent: repeated ids stay repeated rows, a null id is kept, other columns are not read. A text
    is worked on whole in one task, at some 100 bytes a word. An empty table gives an empty one.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col))
    return rows.mapInArrow(partial(_detect, least=least), schema)


def _stutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
            words = (text or b"").split() if h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join([words[i if i < a else a + (i - a) % p] for i in range(n)])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def stuttering(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where each tenth text, chosen by the crc32 of its id, repeats a part of itself
    up to its end. A null id counts as the empty text; a text without words stays."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_stutter, "doc_id long, text string")

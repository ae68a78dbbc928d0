"""Removing repeated passages, found exactly by super-k-mers of words.

A window is a run of ``width`` words of one document. A window's minimiser is the gram of ``gram``
words in it with the least hash, the first of equals; equal windows have equal minimisers at equal
places. Consecutive windows that share the place of their minimiser form a super-k-mer and travel as
one packed string to the bucket of the minimiser.

1. All super-k-mers are counted by minimiser. A window that occurs twice has a minimiser that occurs
   twice, so only super-k-mers of such minimisers need to travel. The repeated minimisers are held as
   a Bloom filter of a fixed largest size; where it errs, a string travels in vain and nothing is lost.
2. Equal packed strings are merged into the first of them, on the map side already. The windows of
   all later copies are repeats as a whole.
3. In a bucket, the windows of the remaining strings are sorted; of equal windows all but the first are
   repeats. A minimiser that owns more than one in ``HOT_SHARE`` of all super-k-mers is replaced by
   hashes of its windows, each travelling on its own, so that a frequent gram is dealt over many buckets.
4. Every document gets the verdicts on its own first strings, forms its super-k-mers again, takes
   those without a verdict for copies, and drops the words that repeated windows cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import id_of, shown_id, slices, text_of
from rubricon.session import bounded_batches, stored

HOT_SHARE, HOT_LEAST = 4096, 64
FILTER_BITS = 1 << 28  # 32 MB at most
BLOCK_BITS = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: where each begins and ends in the joined bytes, and its hash."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.start, self.end = edges[::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        #: First word of every text, and the end.
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes)]))
        self.hash = self._hashes(data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all words, eight bytes of each at a time; they order grams, equality is by bytes."""
        length = self.end - self.start
        out = length.astype(np.uint64) * _ODD
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes = np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1))
        todo, at = np.arange(len(length)), 0
        while len(todo):
            left = length[todo] - at
            lane = np.ascontiguousarray(lanes[self.start[todo] + at]).view("<u8").ravel()
            cut = (8 - np.minimum(left, 8)).astype(np.uint64) * np.uint64(8)
            lane = (lane << cut) >> cut
            out[todo] = _mixed((out[todo] ^ lane) * _ODD + np.uint64(at + 1))
            todo, at = todo[left > 8], at + 8
        return out

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the grams that start at each word but the last n - 1."""
        out = self.hash[: len(self.hash) - n + 1].copy()
        for k in range(1, n):
            out = _mixed(out * _ODD + self.hash[k : len(self.hash) - n + 1 + k])
        return out


class SuperKmers:
    """The super-k-mers of some texts: text, first word in it, number of windows, minimiser, and whether
    it is one window of a hot minimiser, with a hash of the window instead."""

    def __init__(self, words: Words, width: int, gram: int, hot: np.ndarray):
        n_words = np.diff(words.first)
        self.words, self.width = words, width
        total = len(words.hash)
        empty = np.zeros(0, np.int64)
        self.text = self.start = self.windows = empty
        self.minimiser, self.alone = np.zeros(0, np.uint64), np.zeros(0, bool)
        if total < width or n_words.max(initial=0) < width:
            return
        grams = words.grams(gram)
        # Doubling finds the place of the least gram among the width - gram + 1 ones of each window.
        span = width - gram + 1
        place, reach = np.arange(len(grams)), 1
        while reach < span:
            step = min(reach, span - reach)
            left, right = place[: len(place) - step], place[step:]
            place = np.where(grams[right] < grams[left], right, left)
            reach += step
        text_of_word = np.repeat(np.arange(len(n_words)), n_words)
        n = total - width + 1
        whole = text_of_word[:n] == text_of_word[width - 1 :]
        place = place[:n]
        minimiser = grams[place]
        fresh = np.ones(n, bool)
        fresh[1:] = (place[1:] != place[:-1]) | (text_of_word[1:n] != text_of_word[: n - 1])
        is_hot = np.zeros(n, bool)
        if len(hot):
            at = np.searchsorted(hot, minimiser)
            is_hot = hot[np.minimum(at, len(hot) - 1)] == minimiser
            fresh[1:] |= is_hot[1:] | is_hot[:-1]
            if is_hot.any():
                minimiser = np.where(is_hot, words.grams(width), minimiser)
        at = np.flatnonzero(fresh & whole)
        ends = np.append(np.flatnonzero(fresh | ~whole), n)
        stop = ends[np.searchsorted(ends, at, side="right")]
        self.text = text_of_word[at]
        self.start = at - words.first[self.text]
        self.windows = stop - at
        self.minimiser, self.alone = minimiser[at], is_hot[at]

    def packed(self, i: int) -> bytes:
        """The words of one super-k-mer, parted by single spaces."""
        a = self.words.first[self.text[i]] + self.start[i]
        b = a + self.windows[i] + self.width - 2
        return b" ".join(self.words.raw[self.words.start[a] : self.words.end[b]].split())


def _filter_places(minimisers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    other = _mixed(minimisers + _ODD)
    return minimisers & np.uint64(bits - 1), other & np.uint64(bits - 1)


def _formed(batch: pa.RecordBatch, width: int, gram: int, hot: np.ndarray) -> Iterator[tuple[int, Words, SuperKmers]]:
    """Words and super-k-mers of a batch (its last column the text), some texts at a time."""
    texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
    for a, b in slices(texts, 1 << 19):
        words = Words(texts[a:b])
        yield a, words, SuperKmers(words, width, gram, hot)


def _counted(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """m, n: every minimiser and in how many super-k-mers it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.minimiser for _, _, s in _formed(batch, width, gram, np.zeros(0, np.uint64))]
            values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["m", "n"])

    return rows.select("text").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))


def _filter(repeated: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of the repeated minimisers: its number of bits, and its bytes."""
    bits = BLOCK_BITS
    while bits < min(FILTER_BITS, 10 * count):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_filter_places(batch.column(0).to_numpy().view(np.uint64), bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both // BLOCK_BITS), pa.array(both % BLOCK_BITS)], names=["block", "bit"])

    def blocks(part):
        import pandas as pd

        flags = np.zeros(BLOCK_BITS, bool)
        flags[part["bit"].to_numpy()] = True
        return pd.DataFrame({"block": [part["block"].iloc[0]], "bytes": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    made = repeated.select("m").mapInArrow(places, "block long, bit long").groupBy("block").applyInPandas(blocks, "block long, bytes binary")
    for r in made.toLocalIterator():
        out[r["block"] * BLOCK_BITS // 8 :][: BLOCK_BITS // 8] = np.frombuffer(r["bytes"], np.uint8)
    return bits, out


def _passes(minimisers: np.ndarray, bits: int, filled: np.ndarray) -> np.ndarray:
    a, b = _filter_places(minimisers, bits)
    has = lambda at: filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return (has(a) & has(b)).astype(bool)


def _sorted_verdicts(rows: list[tuple], width: int) -> list[tuple]:
    """Verdicts on the strings of one bucket, given as (packed, id, mark, start): the windows of each
    that occur earlier, as bits."""
    if len(rows) == 1:
        return [(*rows[0][1:], b"")]
    windows = []
    for i, (packed, key, mark, start) in enumerate(rows):
        parts = packed.split(b" ")
        for k in range(len(parts) - width + 1):
            windows.append((b" ".join(parts[k : k + width]), key, mark, start + k, i, k))
    windows.sort()
    masks = [np.zeros(r[0].count(b" ") + 2 - width, bool) for r in rows]
    for before, this in zip(windows, windows[1:]):
        if before[0] == this[0]:
            masks[this[4]][this[5]] = True
    return [(*r[1:], np.packbits(m).tobytes() if m.any() else b"") for r, m in zip(rows, masks)]


def _in_buckets(width: int):
    """Runs over rows sorted by bucket; a bucket's rows are sorted as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, out = None, []
        for batch in batches:
            for m, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if m != bucket and held:
                    out += _sorted_verdicts(held, width)
                    held = []
                    if len(out) > 20_000:
                        yield _verdict_batch(out)
                        out = []
                bucket = m
                held.append(tuple(row))
        if held:
            out += _sorted_verdicts(held, width)
        if out:
            yield _verdict_batch(out)

    return run


def _verdict_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "mark", "start", "mask"])


def kept_words(
    docs: DataFrame, width: int = 20, gram: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row: the words that stay, parted by single spaces.
    With ``carry`` also the row itself as the struct ``row``.

    A word goes if a window of ``width`` words covers it that also starts earlier: in a row with a
    smaller id, or before in the same row. Windows are judged on the given texts. A null text has no
    words; texts shorter than a window keep all of theirs. A null id comes before all others. Rows that
    share an id but not the text are ordered by a hash of the text, and rows that share both are one
    document. An empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(
        id_of(id_col).alias("id"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    counts = stored(_counted(rows, width, gram).where("n > 1"), "minimisers")
    total, repeated = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Fewer than HOT_SHARE minimisers can own so much of the total.
    hot = [r["m"] for r in counts.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("m").collect()]
    hot = np.sort(np.array(hot, np.int64).view(np.uint64))
    bits, filled = _filter(counts, repeated)
    shared = docs.sparkSession.sparkContext.broadcast((hot, bits, filled))  # of bounded size

    def travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bits, filled = shared.value
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy() for i in (0, 1))
            for at, words, found in _formed(batch, width, gram, hot):
                yield _travelling(found, ids[at:], marks[at:], _chosen(found, bits, filled))

    strings = rows.select("id", "mark", "text").mapInArrow(travelling, "m long, packed binary, id long, mark long, start long")
    first = F.min(F.struct("id", "mark", "start")).alias("at")
    merged = strings.groupBy("m", "packed").agg(first).select("m", "packed", "at.id", "at.mark", "at.start")
    dealt = merged.repartition("m").sortWithinPartitions("m")
    verdicts = dealt.mapInArrow(_in_buckets(width), "id long, mark long, start long, mask binary")
    by_text = verdicts.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "mask")).alias("verdicts"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bits, filled = shared.value
        for batch in batches:
            given = batch.column(1).to_pylist()
            out = [
                row
                for at, words, found in _formed(batch, width, gram, hot)
                for row in _cleaned(words, found, given[at:], _chosen(found, bits, filled))
            ]
            columns = [*batch.columns[2:-1], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))]
            names = [*batch.schema.names[2:-1], "n_words", "n_removed", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = rows.join(by_text, ["id", "mark"], "left").select("mark", "verdicts", "id", *(["row"] if carry else []), "text")
    schema = "id long" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    out = joined.mapInArrow(cleaned, f"{schema}, n_words long, n_removed long, kept string")
    return out.withColumn("id", shown_id("id")).withColumnRenamed("id", "doc_id")


def _chosen(found: SuperKmers, bits: int, filled: np.ndarray) -> np.ndarray:
    """Which super-k-mers travel: those of repeated minimisers and all windows of hot ones."""
    return np.flatnonzero(found.alone | _passes(found.minimiser, bits, filled))


def _travelling(found: SuperKmers, ids: np.ndarray, marks: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    text = found.text[at]
    columns = [
        pa.array(found.minimiser[at].view(np.int64)),
        pa.array([found.packed(i) for i in at.tolist()], pa.binary()),
        pa.array(ids[text]),
        pa.array(marks[text]),
        pa.array(found.start[at]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["m", "packed", "id", "mark", "start"])


def _cleaned(words: Words, found: SuperKmers, verdicts: list, at: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """n_words, n_removed, kept of every text."""
    width = found.width
    bounds = np.searchsorted(found.text[at], np.arange(len(words.first)))
    starts, windows = found.start.tolist(), found.windows.tolist()
    for i in range(len(words.first) - 1):
        a, b = int(words.first[i]), int(words.first[i + 1])
        n = b - a
        cover = np.zeros(n + 1, np.int64)
        known = {v["start"]: v["mask"] for v in verdicts[i] or ()}
        for j in at[bounds[i] : bounds[i + 1]].tolist():
            start, length = starts[j], windows[j]
            mask = known.get(start)
            if mask is None:  # a copy of an earlier string
                cover[start] += 1
                cover[start + length - 1 + width] -= 1
            elif mask:
                hits = start + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=length))
                np.add.at(cover, hits, 1)
                np.add.at(cover, hits + width, -1)
        gone = np.cumsum(cover[:n]) > 0
        if a == b:
            yield 0, 0, ""
            continue
        parts = words.raw[words.start[a] : words.end[b - 1]].split()
        if gone.any():
            parts = [parts[k] for k in np.flatnonzero(~gone).tolist()]
        yield n, n - len(parts), b" ".join(parts).decode()

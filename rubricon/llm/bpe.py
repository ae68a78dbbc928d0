"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A text is cut into leaves, which are encoded in parallel and joined pairwise up a tree. Leaves end
where white space follows other text, about every ``LEAF_CHARS`` characters: no token and no part of
the vocabulary's splitting pattern reaches across such a seam. A run without a seam is split by the
pattern, and a part that is still long is halved again and again. A text of one leaf is encoded where
it is read; the leaves of longer ones are dealt over the cluster.

Two neighbours are joined by encoding a window around their seam anew, which doubles until both sides
agree. Inside an unsplit part they agree when the window's first id is the one the left side has there
and its last id the one of the right side: then every adjacent pair of ids has been made by the
merges, and the joined ids are those of the whole. At a seam all ids of the window must be the same.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import id_of, shown_id, text_of
from rubricon.llm.vocabulary import PARTS, ByteLevel

LEAF_CHARS = 8_192
LEAF_BYTES = 4_096
_SEAM = regex.compile(r"[^\s](?=[ \n])")
# A run without seams, with the white space that its first part takes along.
_RUN = regex.compile(rf"(?:\A|(?<=[^\s])(?=[ \n]))\s*[^ \n]{{{2 * LEAF_BYTES},}}(?<=[^\s])(?=[ \n]|\Z)")
_PART = regex.compile(PARTS)


def stretches(text: str, length: int = LEAF_CHARS) -> Iterator[str]:
    """Cut a text at places where white space follows other text, about every ``length`` characters."""
    at = 0
    while len(text) - at > length:
        seam = _SEAM.search(text, at + length - 1)
        if not seam:
            break
        yield text[at : seam.end()]
        at = seam.end()
    yield text[at:]


def leaves(text: str, special: regex.Pattern | None) -> Iterator[tuple[int, bool, bytes]]:
    """(group, single, bytes): the leaves of a long text in order. Leaves of a group with ``single``
    are the halves of one unsplit part; any other leaf is text that is encoded on its own. A group with
    a negative number goes on from the one before it; all others start at a seam."""
    group = 0

    def runs() -> Iterator[tuple[bool, str]]:
        for stretch in stretches(text):
            at = 0
            for run in _RUN.finditer(stretch):
                if run.start() > at:
                    yield False, stretch[at : run.start()]
                yield True, run.group()
                at = run.end()
            if at < len(stretch):
                yield False, stretch[at:]

    for unsplit, run in runs():
        if not unsplit:
            group += 1
            yield group, False, run.encode()
            continue
        at, sign = 0, 1
        marks = [*(special.finditer(run) if special else ()), None]
        for mark in marks:
            for part in _PART.findall(run[at : mark.start() if mark else len(run)]):
                raw, group = part.encode(), group + 1
                if len(raw) <= 2 * LEAF_BYTES:
                    yield sign * group, False, raw
                else:
                    for leaf in halves(raw):
                        yield sign * group, True, leaf
                sign = -1
            if mark:
                group += 1
                yield sign * group, False, mark.group().encode()
                at, sign = mark.end(), -1


def halves(raw: bytes) -> list[bytes]:
    if len(raw) <= LEAF_BYTES:
        return [raw]
    middle = len(raw) // 2
    return halves(raw[:middle]) + halves(raw[middle:])


def joined(left: list[int], right: list[int], codec: ByteLevel) -> list[int]:
    """Ids of the concatenated bytes of two encoded neighbours."""
    if not left or not right:
        return left or right
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        window = codec.merge(codec.bytes_of(a) + codec.bytes_of(b))
        if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def seamed(left: list[int], right: list[int], codec: ByteLevel) -> list[int]:
    """Ids of two encoded neighbours that meet at a seam."""
    if not left or not right:
        return left or right
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        raw = codec.bytes_of(a) + codec.bytes_of(b)
        whole = len(a) == len(left) and len(b) == len(right)
        text = raw.decode("utf-8", "strict" if whole else "replace")
        window = codec.encode(text)
        if whole or window == a + b:
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def concatenated(parts: list[list[int]], codec: ByteLevel, join=joined) -> list[int]:
    """Join neighbours pairwise until one list is left."""
    while len(parts) > 1:
        pairs = [join(a, b, codec) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[2 * len(pairs) :]
    return parts[0]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, binary) of every text.

    Null text is empty and has no ids. Rows that repeat an id stay rows of their own. An empty table
    gives an empty one. Other columns of ``docs`` are not read.
    """
    rows = docs.select(id_of(id_col).alias("id"), text_of(text_col).alias("text"))
    short = rows.where(F.length("text") <= leaf_chars).mapInArrow(_encoder(path), "id long, ids binary")
    long = rows.where(F.length("text") > leaf_chars)
    cut = long.mapInArrow(_cutter(path), "id long, mark long, leaf int, grp int, single boolean, raw binary")
    dealt = cut.repartition(F.xxhash64("id", "mark", "leaf"))
    done = dealt.mapInArrow(_leaf_encoder(path), "id long, mark long, leaf int, grp int, single boolean, ids binary")
    whole = done.groupBy("id", "mark").applyInPandas(_tree(path), "id long, ids binary")
    return short.unionByName(whole).select(shown_id("id").alias("doc_id"), "ids")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteLevel.of(path)
        for batch in batches:
            ids = [array("I", codec.encode(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


def _cutter(path: str):
    """One row per leaf. ``mark`` is a hash of the text: it keeps rows of one id apart."""
    import xxhash

    names = ["id", "mark", "leaf", "grp", "single", "raw"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = ByteLevel.of(path).parts
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                mark = xxhash.xxh64_intdigest(text.encode()) - 2**63
                rows = [(key, mark, i, *leaf) for i, leaf in enumerate(leaves(text, special))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _leaf_encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteLevel.of(path)
        for batch in batches:
            *kept, single, raw = batch.columns
            ids = [
                array("I", codec.merge(r.as_py()) if s.as_py() else codec.encode(r.as_py().decode())).tobytes()
                for s, r in zip(single, raw)
            ]
            names = [*batch.schema.names[:-1], "ids"]
            yield pa.RecordBatch.from_arrays([*kept, single, pa.array(ids, pa.binary())], names=names)

    return run


def _tree(path: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        codec = ByteLevel.of(path)
        copies = int((part["leaf"] == 0).sum())  # rows that repeat id and text
        part = part.sort_values("leaf").drop_duplicates("leaf")
        between: list[list[int]] = []  # the ids from seam to seam
        for grp, group in part.groupby("grp", sort=False):
            lists = [list(memoryview(x).cast("I")) for x in group["ids"]]
            found = concatenated(lists, codec) if group["single"].iloc[0] else lists[0]
            if grp < 0:
                between[-1] += found
            else:
                between.append(found)
        ids = array("I", concatenated(between, codec, seamed))
        return pd.DataFrame({"id": [part["id"].iloc[0]] * copies, "ids": [ids.tobytes()] * copies})

    return run


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` (doc_id, ids) with the column text: the decoded ids, special tokens as their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteLevel.of(path)
        for batch in batches:
            texts = [codec.bytes_of(list(memoryview(x.as_py()).cast("I"))).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")

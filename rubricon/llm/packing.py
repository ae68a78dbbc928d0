"""Packing token sequences by minimum bin slack.

Lengths are whole numbers up to the sequence size, so the problem is the histogram of lengths and
not the documents. The plan works on that histogram: a bin starts with the longest length left, a
subset-sum over the lengths still in stock, kept as the bits of one integer, finds the fullest
filling, and the pattern is taken as often as the stock allows. Each pattern uses up a length, so
there are at most as many patterns as lengths. Pieces are then numbered within their length, and a
number tells bin and offset.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import id_of, shown_id, text_of
from rubricon.llm.vocabulary import Words
from rubricon.session import bounded_batches, stored

CELL_PIECES = 16_384


def fullest(stock: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with their multiplicity, whose sum is the largest one up to ``room``.

    Longer lengths are offered first, so that of equal sums the one with fewer parts is likely.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in stock if x <= room), reverse=True):
        left, take = min(stock[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(stock: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Rows (length, first number, multiplicity, first bin, offset): pieces of a length numbered from
    ``first number`` go to bins from ``first bin`` on, ``multiplicity`` to a bin, from ``offset`` on."""
    stock = {k: n for k, n in stock.items() if n}
    numbered = dict.fromkeys(stock, 0)
    rows, bins = [], 0
    while stock:
        longest = max(stock)
        rest = {k: n - (k == longest) for k, n in stock.items() if n > (k == longest)}
        pattern = fullest(rest, size - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(stock[k] // m for k, m in pattern.items())
        offset = 0
        for length in sorted(pattern, reverse=True):
            m = pattern[length]
            rows.append((length, numbered[length], m, bins, offset))
            numbered[length] += m * times
            offset += m * length
            stock[length] -= m * times
            if not stock[length]:
                del stock[length]
        bins += times
    rows.sort()
    names = ("length", "first", "multiplicity", "bin", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def pieces(
    docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids) of every piece of every tokenised text.

    A text is its ids and then ``end_id``; only texts longer than ``size`` are cut.
    """
    bounded_batches(docs.sparkSession)
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py()) + end
                for i in range(0, len(ids), 4 * size):
                    part = ids[i : i + 4 * size]
                    row = (key, i // (4 * size), i // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (part,) if with_ids else row)
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    spark_schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(id_of(id_col), text_of(text_col)).mapInArrow(cut, spark_schema)


def packed(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Every row of ``cut`` (id, piece, length and more) with sequence_id and offset.

    The table is read twice: store it before if it is costly to make.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = plan(histogram, size)
    cells = max(1, math.ceil(sum(histogram.values()) / CELL_PIECES))
    keys = ["length", "_cell"]
    rows = cut.withColumn("_cell", F.pmod(F.xxhash64("id", "piece"), F.lit(cells)))
    order = Window.partitionBy("length").orderBy("_cell")
    offsets = (
        rows.groupBy(*keys)
        .count()
        .select(*keys, (F.sum("count").over(order) - F.col("count")).alias("_from"))
    )
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("id", "piece")))
    numbered = numbered.join(offsets, keys).withColumn("_at", F.col("_from") + F.col("_at") - 1)
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lengths are below 2**22 and numbers below 2**41.
        starts = (table["length"] << 41) + table["first"]
        for batch in batches:
            length, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_at"))
            row = np.searchsorted(starts, (length << 41) + at, side="right") - 1
            n = at - table["first"][row]
            m = table["multiplicity"][row]
            bins, offset = table["bin"][row] + n // m, table["offset"][row] + (n % m) * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return numbered.select(*names, "_at").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def best_fit(
    docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): all of ``docs`` packed.

    Null text is empty and gives a piece of one id. Rows that repeat an id are packed like any
    others. An empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    cut = stored(pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pieces")
    return packed(cut, size).withColumn("id", shown_id("id")).withColumnRenamed("id", "doc_id")

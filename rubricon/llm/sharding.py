"""Sharding by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie side by side. The splitters between
shards are found by counting: each round lays probes over the bracket of every open splitter and
sums the exact bytes between probes over all partitions; the driver sees at most ``probes`` sums a
splitter and narrows each bracket to one cell. A splitter is settled when it meets the tolerance
between two texts; when the bracket is down to one text that is too large for that, the search goes
on among the id hashes of its rows. Then every row moves once, to its shard and a cell there, is put
in order and numbered. Cells follow the hash of the id, so copies of one text spread over them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import text_of
from rubricon.session import stored

TOP = 2**63 - 2
CELL_ROWS = 10_000


@dataclass
class _Search:
    """One splitter: rows before the key (hash, tie) go to lower shards."""

    target: float
    low: int = 0
    high: int = TOP
    base: int = 0
    inside: int | None = None
    found: tuple[int, int] | None = None


def _counted(rows: DataFrame, brackets: list[tuple], probes: int) -> dict[tuple, list]:
    """For every bracket, (first key, last key, bytes, rows) of its non-empty cells in order."""
    which = F.lit(None).cast("struct<b:int,c:long,k:long>")
    for b, (inside, low, high) in enumerate(brackets):
        key = "hash" if inside is None else "tie"
        within = F.col(key).between(low, high)
        if inside is not None:
            within = within & (F.col("hash") == inside)
        cell = F.expr(f"({key} - {low}L) div {(high - low) // probes + 1}L")
        which = F.when(within, F.struct(F.lit(b).alias("b"), cell.alias("c"), F.col(key).alias("k"))).otherwise(which)
    sums = (
        rows.select(which.alias("w"), "size")
        .where("w is not null")
        .groupBy("w.b", "w.c")
        .agg(F.min("w.k").alias("lo"), F.max("w.k").alias("hi"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    )
    out: dict[tuple, list] = {bracket: [] for bracket in brackets}
    for r in sorted(sums.collect(), key=lambda r: (r["b"], r["lo"])):
        out[brackets[r["b"]]].append((r["lo"], r["hi"], int(r["bytes"]), r["n"]))
    return out


def splitters(rows: DataFrame, shards: int, total: int, tolerance: float, probes: int) -> list[tuple[int, int]]:
    """Keys (hash, tie) that part ``rows`` (hash, tie, size) into shards of nearly equal bytes."""
    slack = tolerance * total / shards
    searches = [_Search(total * s / shards) for s in range(1, shards)]
    while any(s.found is None for s in searches):
        searching = [s for s in searches if s.found is None]
        brackets = list(dict.fromkeys((s.inside, s.low, s.high) for s in searching))
        counted = _counted(rows, brackets, probes)
        for s in searching:
            _narrow(s, counted[s.inside, s.low, s.high], slack)
    return [s.found for s in searches]


def _narrow(s: _Search, cells: list, slack: float) -> None:
    before = s.base
    for low, high, size, n in cells:
        if before + size >= s.target:
            break
        before += size
    start, end = ((low, 0), (high + 1, 0)) if s.inside is None else ((s.inside, low), (s.inside, high + 1))
    nearest = start if s.target - before <= before + size - s.target else end
    if min(s.target - before, before + size - s.target) <= slack or (low == high and (s.inside is not None or n == 1)):
        s.found = nearest
    elif low == high:  # one text of several rows
        s.inside, s.low, s.high, s.base = low, 0, TOP, before
    else:
        s.low, s.high, s.base = low, high, before


def _shard(found: list[tuple[int, int]]) -> Column:
    below = [(F.col("_hash") < h) | ((F.col("_hash") == h) & (F.col("_tie") < d)) for h, d in found]
    return sum((F.when(b, 0).otherwise(1) for b in below), F.lit(0)).cast("int")


def balanced_shards(
    docs: DataFrame,
    shards: int = 8,
    tolerance: float = 0.001,
    probes: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with size, shard and slot: shards of nearly equal bytes, slots gapless from 0.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. A splitter lies within
    ``tolerance`` of the ideal shard size, or at the nearest place between two rows where single
    rows are larger than that. Equal texts share a shard unless the splitter's place forces them
    apart. Rows that repeat an id and text lie side by side, also those with a null id.
    An empty table gives an empty one. Columns of ``docs`` named size, shard or slot are replaced.
    """
    size = (F.octet_length(text_of(text_col)) + 1).cast("long")
    hashed = F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("id")), 1)
    narrow = stored(docs.select(hashed.alias("hash"), tie.alias("tie"), size.alias("size")), "sizes")
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    found = splitters(narrow, shards, int(total), tolerance, probes) if n else []

    cells = max(1, math.ceil(n / CELL_ROWS))
    keys = ["_shard", "_cell"]

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_shard": _shard(found), "_cell": F.pmod(F.col("_tie"), F.lit(cells))})

    counts = placed(narrow.select(F.col("hash").alias("_hash"), F.col("tie").alias("_tie"))).groupBy(*keys).count()
    order = Window.partitionBy("_shard").orderBy("_cell")
    offsets = counts.select(*keys, (F.sum("count").over(order) - F.col("count")).alias("_from"))
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    rows = placed(docs.select(*kept, size.alias("size"), hashed.alias("_hash"), tie.alias("_tie")))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", "_tie")))
    return numbered.join(offsets, keys).select(
        *kept, "size", F.col("_shard").alias("shard"), (F.col("_from") + F.col("_at") - 1).cast("long").alias("slot")
    )

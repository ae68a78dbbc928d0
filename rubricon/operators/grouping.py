"""Grouping primitives that stay flat when one key holds much of the data.

None of these gathers a group into one task: selections are aggregates with
map-side combine, medians are looked up in ranges of counts, and row numbers are
the sum of a small prefix table and a numbering inside bounded buckets or ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.session import stored

# Rows up to which a lookup table is broadcast, and bits of a filter of terms.
LOOKUP_ROWS, FILTER_BITS = 200_000, 1 << 24


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of every key. ``order`` must be total within a key."""
    return _pick(df, keys, order, F.min_by, F.min)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the last row of every key. ``order`` must be total within a key."""
    return _pick(df, keys, order, F.max_by, F.max)


def _pick(df, keys, order, chooser, extreme):
    rest = _rest(df, keys)
    if not rest:
        return df.distinct()
    if len(rest) == 1 and len(order) == 1 and isinstance(order[0], str) and rest[0] == order[0]:
        # A plain minimum or maximum aggregates by hash without sorting.
        return df.groupBy(*keys).agg(extreme(rest[0]).alias(rest[0])).select(*df.columns)
    return (
        df.groupBy(*keys)
        .agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def exploded(df: DataFrame, keep: Sequence[str | Column], items: Column, pos: str, value: str) -> DataFrame:
    """One row per array item. A plain explode makes the optimizer test the array for emptiness
    at the scan, which evaluates a costly array expression twice; the outer form does not."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, value)).where(F.col(pos).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Deal an input with fewer splits than cores over all cores before costly row work. Inputs
    with enough splits, as any large table has, are returned as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_for(df: DataFrame, rows: int = 250_000) -> int:
    """How many tasks take about ``rows`` rows of ``df`` each, but at least one a core. The rows are
    counted: a shuffle that Spark sizes by bytes gives a task millions of rows that compress well."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def lookups(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks lookups of no more rows than ``table``, a stored one: they are broadcast if it has few.
    Spark knows the bytes of files only, so it would move all rows that are looked up in what it has yet
    to compute."""
    return F.broadcast if table.count() <= LOOKUP_ROWS else lambda lookup: lookup


def maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among that of ``wanted``, a stored table: all that are, and some more.

    A filter of ``FILTER_BITS`` bits at most, one a hash, in words of 64 that are broadcast. It spares
    rows the way to a join with ``wanted``, which settles the rest."""
    at = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    place = {"_word": F.shiftright(at, 6), "_bit": F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))}
    words = wanted.select(column).distinct().withColumns(place).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumns(place).join(F.broadcast(stored(words, "filter")), "_word")
    return marked.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Sequence[str | Column], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join rows with a lookup of one row per key where a key may own much of the rows.

    Rows of a key are dealt over ``salts`` partitions by the ``spread`` columns and the lookup
    is repeated for each. An aggregate on the key after the join still combines on the map
    side, since its input is no longer partitioned by the key alone.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def score_summary(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, exact interpolated median, min, max and non-null count per group; NaN counts as null.

    Rows are reduced to a count per distinct value. These are dealt to ranges of (group, value) and
    stored once; sums over the ranges tell which one holds the middle of a group, and only that one is
    searched. Neither rows nor distinct values of a group meet in one task.
    """
    group = list(group)
    number = F.col(value).cast("double")
    rows = df.select(*group, F.when(~F.isnan(number), number).alias("_v"))
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    counts = rows.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(*group, "_v")
    counts = stored(counts.withColumn("_part", F.spark_partition_id()), "value-counts")
    filled = F.when(F.col("_v").isNotNull(), F.col("_n"))
    stats = counts.groupBy(*group).agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum(filled)).alias("mean_score"),
        F.min("_v").alias("min_score"),
        F.max("_v").alias("max_score"),
        F.coalesce(F.sum(filled), F.lit(0)).alias("n"),
    )
    middle = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    wanted = stats.where("n > 0").select(*group, F.explode(F.array_distinct(middle)).alias("_rank"))
    medians = _ranked_values(counts.where("_v is not null"), wanted, group).groupBy(*group).agg(F.avg("_v").alias("median_score"))
    return stats.join(medians, group, "left").select(
        *group, "mean_score", "median_score", "min_score", "max_score", "n"
    )


def _ranked_values(counts: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """The value at each wanted 0-based rank of a group: ``<group>, _rank, _v``. ``counts`` has values
    with their number and their range of (group, value)."""
    parts = counts.groupBy(*group, "_part").agg(F.sum("_n").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_part"))
    parts = parts.withColumn("_before", upto - F.col("_c"))
    held = parts.join(wanted, group).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    inside = counts.join(held.drop("_c"), [*group, "_part"])
    above = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_rank").orderBy("_v"))
    return inside.withColumn("_above", above).where("_rank < _above and _rank >= _above - _n").select(*group, "_rank", "_v")


def ranked(df: DataFrame, order: Sequence[str | Column], out: str, within: Sequence[str | Column] = ()) -> DataFrame:
    """Add the 0-based place of every row in the order of the whole table.

    Rows are range partitioned and sorted once and written with their place in their partition; the
    driver adds up the row counts of the partitions. Rows that ``order`` does not part share a
    partition, so give it columns that do; long ones that only order such rows belong in ``within``,
    since the driver samples ``order``. The result is a stored table in ranges of the order.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order, *within)
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(counts, default=0) + 1):
        starts.append(before)
        before += counts.get(p, 0)
    start = F.element_at(F.lit(np.array(starts, np.int64)), part.cast("int") + 1)
    return placed.withColumn(out, start + within).drop("_at")


def numbered(
    df: DataFrame, group: Sequence[str], levels: Sequence[str], idx: str, out: str, width: int = 65_536
) -> DataFrame:
    """0-based position inside ``group`` ordered by ``levels`` descending, then by the
    integer ``idx`` ascending, without sorting any group in one task.

    Rows are numbered inside buckets of ``width`` consecutive ``idx`` values; the
    offset of each bucket is a running sum over the much smaller bucket counts.
    ``idx`` must be unique within ``group``.
    """
    group, levels = list(group), list(levels)
    bucketed = df.withColumn("_bkt", F.floor(F.col(idx) / width))
    keys = [*group, *levels, "_bkt"]
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    order = [*[F.col(c).desc() for c in levels], F.col("_bkt").asc()]
    offsets = counts.withColumn(
        "_off", F.sum("_c").over(Window.partitionBy(*group).orderBy(*order)) - F.col("_c")
    ).drop("_c")
    within = Window.partitionBy(*keys).orderBy(F.col(idx).asc())
    return (
        bucketed.withColumn("_rn", F.row_number().over(within))
        .join(offsets, keys)
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .select(*df.columns, out)
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """Best ``k`` rows per group with a 0-based rank. The row_number limit lets Spark
    prune every map task to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .withColumn(out, F.col("_rn") - 1)
        .drop("_rn")
    )

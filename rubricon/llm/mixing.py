"""Mixing sources to target weights by entropy balancing.

Every source has a target of words. Documents get rates r, how often they are taken on average, that
stay as near to one as the targets allow: minimise the sum of r log r - r + 1 over all documents such
that size times r sums to the target of every source and r is at most ``most``. The dual of this convex
problem has one multiplier a source, and its solution is an exponential tilt,

    r = min(most, exp(multiplier x size / typical size of the source)).

Newton's iterations find the multipliers. Each is one aggregate over the counts of (source, size),
which are all that rates depend on; sums are exact decimals, so that reruns agree whatever order rows
come in. Rates become whole copies: the sizes of a source, the largest first, get the rounded number
of copies of their documents, and what rounding leaves goes on to the next size. Documents of one size
share its copies evenly, the odd ones going by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import SPACE, id_of, shown_id, text_of
from rubricon.operators.grouping import ranked, salted_join
from rubricon.session import stored

EXACT = 1e-10
ROUNDS = 60
_SOURCE = ["unknown", "source"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Add to (unknown, source, source_size) the target of every source, as a stored table.

    Sources in order of their names, a null one last, have the weights in turn and share all words by
    them. A target above ``most`` times the source's size stops there, and the others share its excess
    by weight, until none is above.
    """
    turn = F.lit([float(w) for w in weights])
    named = ranked(sources, _SOURCE, "_place")
    held = named.withColumn("weight", F.element_at(turn, (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place")
    room = F.col("source_size") * float(most)
    total = F.sum("source_size").cast("double")
    level, closed = 0.0, -1
    while True:
        full = room <= F.col("weight") * level if closed >= 0 else F.lit(False)
        sums = held.agg(
            total.alias("total"),
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("closed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if sums["n"] == closed or not sums["open"]:
            break
        level, closed = (sums["total"] - most * sums["closed"]) / sums["open"], sums["n"]
    return stored(held.withColumn("target", F.least(room, F.col("weight") * level)).drop("weight"), "targets")


def _rate(most: float) -> Column:
    tilt = F.col("tilt") * F.col("size") / F.col("typical")
    return F.when(F.col("full") | (tilt >= math.log(most)), float(most)).otherwise(F.exp(tilt))


def tilts(classes: DataFrame, aims: DataFrame, most: float) -> DataFrame:
    """unknown, source, typical, full, tilt: the solution of the dual, as a stored table.

    ``classes`` counts the ``n`` documents of every source and size. A source whose target is ``most``
    times its size is ``full``: its rates are at the bound. Newton's steps work on the logarithm of the
    words taken; a step that leaves the bracket of the root is replaced by the bracket's middle.
    """
    square = F.sum((F.col("size") * F.col("size") * F.col("n")).cast("decimal(38,0)")).cast("double")
    spans = classes.where("size > 0").groupBy(*_SOURCE).agg(square.alias("_square"))
    state = aims.where("source_size > 0").join(spans, _SOURCE)
    state = state.withColumns({
        "typical": F.col("_square") / F.col("source_size"),
        "full": F.col("target") >= F.col("source_size") * float(most) * (1 - EXACT),
        "tilt": F.log(F.col("target") / F.col("source_size")),
        "low": F.lit(None).cast("double"),
        "high": F.lit(None).cast("double"),
        "done": F.lit(False),
    })
    state = state.withColumn("done", F.col("full"))
    state = stored(state.drop("_square", "source_size"), "tilts")
    for _ in range(ROUNDS):
        if state.where("not done").isEmpty():
            break
        state = stored(_step(classes, state, most), "tilts")
    return state


def _step(classes: DataFrame, state: DataFrame, most: float) -> DataFrame:
    rate, exact = _rate(most), lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    words = F.col("size").cast("double") * F.col("n") * rate
    slope = F.when(rate < most, words * F.col("size") / F.col("typical")).otherwise(0.0)
    tilted = classes.where("size > 0").join(state.where("not done").select(*_SOURCE, "tilt", "typical", "full"), _SOURCE)
    sums = tilted.groupBy(*_SOURCE).agg(exact(words).alias("_words"), exact(slope).alias("_slope"))
    now, aim, tilt = F.col("_words"), F.col("target"), F.col("tilt")
    low, high = F.when(now < aim, tilt).otherwise(F.col("low")), F.when(now > aim, tilt).otherwise(F.col("high"))
    newton = F.when((F.col("_slope") > 0) & (now > 0), tilt - F.log(now / aim) * now / F.col("_slope"))
    inside = newton.isNotNull() & F.coalesce(newton >= F.col("_low"), F.lit(True)) & F.coalesce(newton <= F.col("_high"), F.lit(True))
    still = F.abs(newton - tilt) <= (F.abs(tilt) + 1) * 1e-12
    near = F.coalesce((F.abs(now - aim) <= aim * EXACT + 1e-6) | still, F.lit(False))
    # Without a bracket yet, the step to the open side doubles.
    open_ = F.when(F.col("_high").isNull(), tilt + F.abs(tilt) + 1).otherwise(tilt - F.abs(tilt) - 1)
    middle = F.coalesce((F.col("_low") + F.col("_high")) / 2, open_)
    moved = state.join(sums, _SOURCE, "left").withColumns({"_low": low, "_high": high})
    settled = F.col("done") | near | F.coalesce(F.col("_high") - F.col("_low") <= 1e-12 * F.abs(tilt), F.lit(False))
    following = F.when(F.col("done") | near, tilt).when(inside, newton).otherwise(middle)
    return moved.select(*_SOURCE, "target", "typical", "full", following.alias("tilt"), F.col("_low").alias("low"), F.col("_high").alias("high"), settled.alias("done"))


def copies(part: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies for the sizes of one source from their rates. What rounding leaves over goes on to
    the next size; what is left in the end changes copies by one more where it still fits."""
    part = part.sort_values("size", ascending=False)
    sizes, ns = part["size"].tolist(), part["n"].tolist()
    out, left = [], 0.0
    for size, n, rate in zip(sizes, ns, part["rate"].tolist()):
        want, least = n * rate, n * int(rate)
        held = min(max(round(want + left / size), least), least if rate == int(rate) else least + n)
        left += (want - held) * size
        out.append(held)
    for i, (size, n) in enumerate(zip(sizes, ns)):
        more = int(left / size) if i < len(sizes) - 1 else round(left / size)
        more = min(max(more, -n, -out[i]), n, most * n - out[i])
        out[i] += more
        left -= more * size
    return part.assign(copies=out)[["unknown", "source", "size", "first", "n", "rate", "copies"]]


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many copies of every document a mix takes: doc_id, size (words), source_size, target (both of
    its source), rate, copies and taken (words, size times copies).

    A null text has no words, a null source is one of its own and comes last, a null id is kept and rows
    that repeat an id are rows of their own. No document is taken more than ``most`` times. A document
    without words is taken once and adds none; a source without words has the target 0. An empty table
    gives an empty one. Only sizes, sources and ids move between tasks, texts do not; one task rounds
    the distinct sizes of a source, fewer than the words of its longest text.
    """
    name = F.col(source_col).cast("string")
    rows = docs.select(
        id_of(id_col).alias("id"),
        word_count(text_of(text_col)).alias("size"),
        name.isNull().alias("unknown"),
        F.coalesce(name, F.lit("")).alias("source"),
        # Parts rows that share an id, so that no range of the order holds more than its share.
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(rows, "sizes")
    placed = ranked(rows, [*_SOURCE, "size", F.xxhash64("id"), "id", "_row"], "place")
    key = [*_SOURCE, "size"]
    classes = stored(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")), "classes")
    sources = classes.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sources, weights, most)
    solved = tilts(classes, aims, most)
    rated = classes.where("size > 0").join(solved, _SOURCE).withColumn("rate", _rate(most)).select(*key, "first", "n", "rate")
    schema = "unknown boolean, source string, size long, first long, n long, rate double, copies long"

    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        return copies(part, most)

    whole = rated.groupBy(*_SOURCE).applyInPandas(rounded, schema)
    bare = classes.where("size = 0").select(*key, "first", "n", F.lit(1.0).alias("rate"), F.col("n").alias("copies"))
    held = stored(whole.unionByName(bare).join(aims, _SOURCE), "copies")
    out = salted_join(placed, held, key, ["place"])
    # The first of a size, in the order of the hash, take the copies that do not go round.
    share = F.expr("copies div n") + F.when(F.col("place") - F.col("first") < F.col("copies") % F.col("n"), 1).otherwise(0)
    return out.select(
        shown_id("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "rate",
        share.alias("copies"),
        (F.col("size") * share).alias("taken"),
    )

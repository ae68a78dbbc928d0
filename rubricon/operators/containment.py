"""Which texts contain which: substring joins by equal grams, inside the JVM.

Where few haystacks share the keys, all of them are compared. Otherwise a needle is looked up by one
gram of its own, and only haystacks that hold that gram are compared.

* Long needles use winnowed grams: of every ``WINDOW`` neighbouring grams of ``GRAM`` characters the one
  with the least hash is kept. A window of the needle is a window of every text around it, so both
  sides keep the same gram of it, and a haystack keeps two in ten of its grams only.
* Shorter needles use all grams of the largest of ``SIZES`` that fits them.

Of a needle's grams the one that the fewest haystacks hold is its anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.operators.grouping import exploded
from rubricon.session import stored

GRAM, WINDOW = 8, 9
SIZES = (1, 2, 3, 8)
FEW = 16
# Characters of needles up to which the grams of haystacks are kept only where a needle has them.
FEW_CHARS = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a costly value that it uses several times, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(text: Column, size: int, window: int = 1) -> Column:
    """Distinct hashes of the grams of a text that are the least of some window of grams; null where
    the text is too short for a window."""

    def hashed(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - (size - 1)), lambda i: F.xxhash64(F.slice(chars, i, F.lit(size))))

    def least(hashes: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        return F.transform(at, lambda i: F.array_min(F.slice(hashes, i, F.lit(window))))

    all_ = let(F.split(text, ""), hashed)
    found = F.array_distinct(all_ if window == 1 else let(all_, least))
    return F.when(F.length(text) >= size + window - 1, found)


def contained(needles: DataFrame, haystacks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``<keys>, needle, haystack``: the needles inside a haystack of the same keys.

    ``needles(<keys>, needle)`` and ``haystacks(<keys>, haystack)`` hold distinct rows without nulls; an
    empty needle is found nowhere. Gram rows carry hashes of gram and text only; the texts come back
    for the comparison, which also settles collisions.
    """
    keys = list(keys)
    if not keys:
        return _by_grams(needles, haystacks, keys)
    groups = haystacks.groupBy(*keys).agg((F.count(F.lit(1)) <= FEW).alias("_few"))
    marked = haystacks.join(groups, keys)
    few = needles.join(marked.where("_few"), keys).where(F.contains("haystack", "needle") & (F.col("needle") != ""))
    many = marked.where("not _few").drop("_few")
    asked = needles.join(groups.where("not _few").select(*keys), keys, "left_semi")
    return few.select(*keys, "needle", "haystack").unionByName(_by_grams(asked, many, keys))


def _by_grams(needles: DataFrame, haystacks: DataFrame, keys: list[str]) -> DataFrame:
    needles = needles.withColumn("_nid", F.xxhash64("needle"))
    haystacks = haystacks.withColumn("_hid", F.xxhash64("haystack"))
    length = F.length("needle")
    kind = F.lit(None).cast("int")  # the size of gram, 0 for winnowed ones
    for size in SIZES:
        kind = F.when(length >= size, size).otherwise(kind)
    kind = F.when(length >= GRAM + WINDOW - 1, 0).otherwise(kind)
    kinds = needles.where(length > 0).groupBy(kind.alias("k")).agg(F.sum(length).alias("n")).collect()
    found = None
    for k, chars in sorted(map(tuple, kinds)):
        size, window = (GRAM, WINDOW) if k == 0 else (k, 1)
        gram = lambda text: grams(F.col(text), size, window)
        need = exploded(needles.where(kind == k), [*keys, "_nid"], gram("needle"), "_i", "_g").drop("_i")
        hay = haystacks.where(F.length("haystack") >= size + window - 1)
        hay = exploded(hay, [*keys, "_hid"], gram("haystack"), "_i", "_g").drop("_i")
        if chars <= FEW_CHARS:
            need = stored(need, "grams")
            hay = hay.join(F.broadcast(need.select(*keys, "_g").distinct()), [*keys, "_g"], "left_semi")
        part = _rarest(need, hay, keys).join(hay, [*keys, "_g"]).select(*keys, "_nid", "_hid")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return needles.withColumn("haystack", F.col("needle")).select(*keys, "needle", "haystack").limit(0)
    return (
        found.join(needles, [*keys, "_nid"])
        .join(haystacks, [*keys, "_hid"])
        .where(F.contains("haystack", "needle"))
        .select(*keys, "needle", "haystack")
    )


def _rarest(need: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """The gram of every needle that the fewest haystacks hold. A needle with a gram that none holds is
    contained nowhere."""
    held = hay.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_df"))
    counted = need.join(held, [*keys, "_g"], "left")
    best = counted.groupBy(*keys, "_nid").agg(
        F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g"), F.min(F.coalesce("_df", F.lit(0))).alias("_df")
    )
    return best.where("_df > 0").drop("_df")

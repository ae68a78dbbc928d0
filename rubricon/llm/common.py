"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white-space characters that part words, as a class body for Java, Python and SQL.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE}]+")
LOWEST = -(2**63)


def text_of(name: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_of(name: str) -> Column:
    """The id as a long that orders totally: a null id comes before all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LOWEST))


def shown_id(name: str) -> Column:
    """Back from ``id_of``."""
    return F.when(F.col(name) != LOWEST, F.col(name))


def fold(name: str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


HASHES = 1 << 30


def hash_share(rows: Column, wanted: int) -> Column:
    """The hashes below which some half more than ``wanted`` of so many rows are expected."""
    share = (F.lit(1.5 * wanted) + 100) / F.greatest(rows, F.lit(1))
    return (F.least(share, F.lit(1.0)) * HASHES).cast("long")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the order of the key's hash: the same ones at every run. A key
    that many rows share may displace others, never exceed the bound."""
    limit = hash_share(F.lit(df.count()), rows)
    near = df.where(F.pmod(F.xxhash64(key), F.lit(HASHES)) < limit)
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(HASHES)), F.col(key)).limit(rows)


def slices(texts: list[str], limit: int = 1 << 20):
    """Cut a batch into runs of whole texts of about ``limit`` characters, so that working arrays
    stay small whatever the batch holds. Yields (first, last) positions."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)

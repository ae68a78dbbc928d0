"""Reading amounts and periods out of fact sentences."""

from __future__ import annotations

import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Amount with unit, period token, bucket width, missing period.
AMOUNT_PATTERN = r"(?i)\$?([\d]+\.?[\d]*)\s*(B|M|K|%)?"
PERIOD_PATTERN = r"(?i)(FY\s*20\d\d|Q[1-4]\s*20\d\d|20\d\d)"
BUCKET_WIDTH = 5
NO_PERIOD = "UNKNOWN"


def is_quantitative(fact: Column) -> Column:
    return fact.rlike(r"(?U)\d")


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII digits they stand for."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    return F.when(text.rlike(r"(?U)[\d&&[^0-9]]"), F.translate(text, *_digits())).otherwise(text)


@F.pandas_udf(T.DoubleType())
def _round_binary(value: pd.Series) -> pd.Series:
    return value.map(lambda v: v if pd.isna(v) else round(v, 1)).astype("float64")


def amount_in_millions(fact: Column, binary_rounding: bool = False) -> Column:
    """First number of the text in millions, one decimal.

    The first number counts even when it is a year, and any b, m or k right after a
    number is taken as its unit. Rounding is half-even on the decimal form inside
    the JVM; ``binary_rounding`` rounds the binary value instead, in Python.
    """
    bare = F.replace(ascii_digits(fact), F.lit(","))
    number = F.regexp_extract(bare, AMOUNT_PATTERN, 1)
    unit = F.upper(F.regexp_extract(bare, AMOUNT_PATTERN, 2))
    value = F.when(number != "", number).cast("double")
    scaled = (
        F.when(unit == "B", value * 1000.0).when(unit == "K", value / 1000.0).otherwise(value)
    )
    return _round_binary(scaled) if binary_rounding else F.bround(scaled, 1)


def period(fact: Column) -> Column:
    found = F.regexp_extract(fact, PERIOD_PATTERN, 1)
    return F.when(found != "", F.replace(F.upper(found), F.lit(" "))).otherwise(F.lit(NO_PERIOD))


def amount_bucket(amount: Column) -> Column:
    return (F.bround(amount / BUCKET_WIDTH) * BUCKET_WIDTH).cast("long")

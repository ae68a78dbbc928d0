"""Price bars: from ticks, from nested payloads, and as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bar columns in output order.
BAR_COLUMNS = [
    "date", "open", "high", "low", "close", "adjOpen", "adjHigh", "adjLow", "adjClose", "volume",
    "adjVolume", "divCash", "splitFactor", "volumeNotional", "tradesDone",
]


def daily_bars(ticks: DataFrame) -> DataFrame:
    """Daily open, high, low, close, summed volume and trade count per symbol.

    ``ticks(symbol, ts, seq, price, volume)``; ``seq`` orders ticks of equal time.
    """
    when = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min_by("price", when).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", when).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("tradesDone"),
    )


def unnested(payloads: DataFrame) -> DataFrame:
    """Bars of nested payloads ``(ticker, priceData array<struct>)``."""
    return payloads.select(F.col("ticker").alias("symbol"), F.inline("priceData"))


def in_range(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    return bars.where(
        (F.upper("symbol") == symbol.strip().upper())
        & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def as_text(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bars as strings: columns without any value are left out, days lose their time part, and
    a missing value reads N/A. Which columns hold values is one aggregate."""
    present = [c for c in BAR_COLUMNS[1:] if c in bars.columns]
    seen = bars.agg(*[F.count(c).alias(c) for c in present]).first()
    active = [c for c in present if seen[c]]
    return bars.select(
        *keep,
        F.substring_index(F.col("date").cast("string"), "T", 1).alias("date"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in active],
    )

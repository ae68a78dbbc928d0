"""Cost and latency of logged agent turns, and answer length accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import word_count


def turn_totals(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns, seconds, retry overhead, tokens and cost per key."""
    total = lambda c: F.sum(c).alias(c)
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"),
        total("duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
        total("retry_overhead_seconds"),
        total("in_tokens"),
        total("out_tokens"),
        total("cache_read_tokens"),
        total("cost_total"),
    )


def tool_totals(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, failures and seconds per tool. ``tool_calls array<struct<name, success, seconds>>``."""
    return (
        turns.select(*keys, F.inline("tool_calls"))
        .groupBy(*keys, "name")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("success")).alias("failures"),
            F.sum("seconds").alias("tool_seconds"),
        )
    )


def flat_turns(raw: DataFrame) -> DataFrame:
    """Turn columns used above from the logged record."""
    m = "query_result.metadata."
    return raw.select(
        *[c for c in ("model", "run", "question", "turn") if c in raw.columns],
        "duration_seconds",
        "retry_overhead_seconds",
        *[F.col(m + c).alias(c) for c in ("in_tokens", "out_tokens", "cache_read_tokens")],
        F.col(m + "cost.total").alias("cost_total"),
        F.transform(
            "tool_call_records",
            lambda r: F.struct(
                r["tool_call"]["name"].alias("name"),
                r["success"].alias("success"),
                r["duration_seconds"].alias("seconds"),
            ),
        ).alias("tool_calls"),
    )


def compression(edited: DataFrame) -> DataFrame:
    """Words before and after editing and the share retained, per row."""
    before, after = word_count(F.col("before")), word_count(F.col("after"))
    rows = edited.withColumn("words_before", before).withColumn("words_after", after)
    return rows.withColumn(
        "retained_pct",
        F.when(F.col("words_before") > 0, F.round(100.0 * F.col("words_after") / F.col("words_before"), 1)).otherwise(0.0),
    )


def compression_total(counted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counted.groupBy(*keys).agg(
        F.sum("words_before").alias("words_before"),
        F.sum("words_after").alias("words_after"),
        F.round(F.sum("words_after") / F.sum("words_before"), 4).alias("compression_ratio"),
    )

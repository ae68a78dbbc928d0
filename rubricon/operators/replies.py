"""Requests out, replies in: the table side of steps done by outside models.

A step renders a requests table, hands it to a scoring callable or to an outside system,
and reads ``request_id, stage, attempt, status, finish_reason, content`` back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.functions.jsontext import find_json

REPLIES = (
    "request_id string, stage string, attempt int, status string, finish_reason string, content string, error string"
)


def request_rows(df: DataFrame, stage: str, keys: list[str], prompt: Column) -> DataFrame:
    """Rendered requests with an id that is stable across runs."""
    rid = F.sha2(F.concat_ws("\x1f", F.lit(stage), *[F.col(k).cast("string") for k in keys]), 256)
    return df.select(rid.alias("request_id"), F.lit(stage).alias("stage"), *keys, prompt.alias("prompt"))


def render(template: str, **values: Column) -> Column:
    """Template text with ``{name}`` filled from columns, each once and without rescanning. Other
    braces stay as they are."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) not in values:
            continue
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def score_requests(
    requests: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 96, partitions: int | None = None
) -> DataFrame:
    """Apply a batch callable to every prompt. A failing batch becomes error rows and the rest
    goes on. ``partitions`` bounds how many batches run at once."""

    def run(frames):
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    content, error = list(fn(list(part["prompt"]))), None
                except Exception as exc:  # the row carries the failure
                    content, error = [None] * len(part), f"{type(exc).__name__}: {exc}"
                yield pd.DataFrame(
                    {
                        "request_id": part["request_id"].to_numpy(),
                        "stage": part["stage"].to_numpy(),
                        "attempt": 1,
                        "status": "ok" if error is None else "failed",
                        "finish_reason": "stop" if error is None else None,
                        "content": content,
                        "error": error,
                    }
                )

    source = requests.select("request_id", "stage", "prompt")
    if partitions:
        source = source.repartition(partitions, "request_id")
    return source.mapInPandas(run, REPLIES)


def usable(replies: DataFrame) -> DataFrame:
    """Last successful, complete reply per request; replies cut off by length are rejected."""
    ok = replies.where((F.col("status") == "ok") & (F.coalesce("finish_reason", F.lit("")) != "length"))
    return ok.groupBy("request_id").agg(F.max_by("content", "attempt").alias("content"))


def read_replies(requests: DataFrame, replies: DataFrame, arrays: bool = True) -> DataFrame:
    """Requests with their parsed reply; ``error`` names a missing or unreadable one."""
    joined = requests.join(usable(replies), "request_id", "left").withColumn(
        "value", find_json(F.col("content"), arrays)
    )
    error = F.when(F.col("content").isNull(), "no reply").when(F.col("value").isNull(), "no JSON in reply")
    return joined.withColumn("error", error)


def reply_or(rows: DataFrame, replies: DataFrame, keys: list[str], column: str, default: Column) -> DataFrame:
    """Rows with their reply text, or a default where there is none (for a document summary, the
    first part of its text)."""
    joined = rows.join(replies.select(*keys, F.col("content").alias("_reply")), keys, "left")
    return joined.withColumn(column, F.coalesce(F.nullif("_reply", F.lit("")), default)).drop("_reply")


def split_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without, and failed rows with, their error."""
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull())

"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rubricon.operators.replies import split_failures


def records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def json_lines(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def with_dead_letters(df: DataFrame, path: str, failures: str) -> None:
    """Good rows to one place, failed rows with their error to another."""
    good, bad = split_failures(df)
    good.write.mode("overwrite").parquet(path)
    bad.write.mode("overwrite").json(failures)


def reports(frames: dict[str, DataFrame], folder: str, files: int = 1) -> None:
    """Report tables as CSV, one folder each. Reports are aggregates of models x groups."""
    for name, df in frames.items():
        df.coalesce(files).write.mode("overwrite").csv(f"{folder}/{name}", header=True)

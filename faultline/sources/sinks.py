"""Sinks. Tables are written by the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Runs, cards, gold labels or reports as JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append to a history table (trend rows or corrections)."""
    df.write.mode("append").parquet(path)

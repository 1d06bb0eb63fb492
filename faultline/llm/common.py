"""Helpers the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []

#: The characters of the Unicode property White_Space, as a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
STABLE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor sees.

    Only a session on one machine may run without the setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="faultline-llm-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written once to the shared folder and read from there: later steps never repeat the work."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value written as text, modulo ``divisor``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small cuts of the batches, so that Python objects exist for a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], name: str, most: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts of the batches whose texts in column ``name`` have about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + most, "right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def gathered(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat``, joined; run i has ``lengths[i]`` items."""
    n = lengths[at]
    shift = (np.cumsum(lengths) - lengths)[at] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(n.sum())]

"""Ordered operations that stay parallel inside one large group.

A plain window over a run sorts the whole run in one task. The helpers here split a group into
buckets that follow the order, work inside each bucket, and carry only one small row per bucket
across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "index"
) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 in ``order``.

    ``bucket`` must not decrease along ``order``. Rows are ranked per (group, bucket); the rank is
    shifted by the number of rows in earlier buckets, which comes from pre-aggregated counts.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_offset")
    )


def with_running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before, per ``keys`` group in ``order``.

    ``bucket`` must not decrease along ``order``. Sums run inside a bucket; one row per bucket carries them on.
    """
    df = df.withColumn("_value", value)
    totals = df.groupBy(*keys, bucket).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.join(carried, [*keys, bucket])
    return summed.withColumn(name, F.col("_carried") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_value", "_carried")


def with_previous(
    df: DataFrame, key: str, chunk: str, order: str, value: Column, name: str
) -> DataFrame:
    """The ``value`` of the row before, per ``key`` group in ``order``; null on the first row.

    Inside a chunk this is a lag. A chunk's first row takes the last value of the nearest earlier
    chunk, found from one row per chunk. ``value`` must grow with ``order``.
    """
    df = df.withColumn("_value", value)
    last = df.groupBy(key, chunk).agg(F.max("_value").alias("_last"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, chunk, F.max("_last").over(before).alias("_carried"))
    inside = Window.partitionBy(key, chunk).orderBy(order)
    return (
        df.join(carried, [key, chunk])
        .withColumn(name, F.coalesce(F.lag("_value").over(inside), F.col("_carried")))
        .drop("_value", "_carried")
    )


def join_by_chunk(
    steps: DataFrame, per_group: DataFrame, key: str, position: str, size: str, chunk_rows: int,
    chunk: str = "chunk",
) -> DataFrame:
    """Join one-row-per-group columns to the group's rows without gathering a group.

    Rows are spread by ``position div chunk_rows``; the group side is repeated once per chunk, which
    its own row count ``size`` bounds, so the join key is (group, chunk) on both sides.
    """
    spread = steps.withColumn(chunk, F.floor(F.col(position) / chunk_rows))
    last_chunk = F.floor((F.greatest(F.col(size), F.lit(1)) - 1) / chunk_rows)
    repeated = per_group.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    return spread.join(repeated, [key, chunk])

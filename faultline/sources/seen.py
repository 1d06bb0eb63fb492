"""A store of the content hashes that were classified, kept between batches.

The store is Parquet, partitioned by the first digits of the hash and by batch. A batch reads only the buckets its own
runs fall into, and only hashes; runs whose content another batch has classified go no further.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.steps import with_run_facts

DIGITS = 2  # 16^DIGITS buckets
STORE_DDL = "content_hash STRING, bucket STRING, batch LONG"


def _bucket(digits: int):
    return F.substring("content_hash", 1, digits)


def _stored(store: str, runs: DataFrame) -> DataFrame:
    spark = runs.sparkSession
    try:
        return spark.read.schema(STORE_DDL).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE_DDL)  # the first batch


def unseen(runs: DataFrame, store: str, batch: int, digits: int = DIGITS) -> DataFrame:
    """Nested runs with ``content_hash`` that no other batch has, one for each content.

    Of runs of one content the one with the smallest id stays. What a batch of the same number left is ignored, so a
    batch that is repeated after a failure finds its runs unseen again.
    """
    hashed = with_run_facts(runs).select(*runs.columns, "content_hash")
    # At most 16^digits values.
    touched = sorted(r[0] for r in hashed.select(_bucket(digits)).distinct().collect() if r[0] is not None)
    known = _stored(store, runs).filter(F.col("bucket").isin(touched) & (F.col("batch") != batch)).select("content_hash")
    first = hashed.groupBy("content_hash").agg(F.min("run_id").alias("run_id")).join(known, "content_hash", "left_anti")
    return hashed.join(first, ["content_hash", "run_id"], "left_semi").dropDuplicates(["content_hash"])


def remember(hashes: DataFrame, store: str, batch: int, digits: int = DIGITS) -> None:
    """Add the ``content_hash`` rows of a classified batch; a batch of the same number is replaced."""
    rows = hashes.select("content_hash", _bucket(digits).alias("bucket"), F.lit(batch).cast("long").alias("batch"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(store)

"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read on from there, so lost executors cost nothing.

    The folder is the cluster's ``spark.checkpoint.dir``; only a local session may fall back to a
    folder of this machine.
    """
    _checkpoint_folder(df)
    return df.checkpoint()


def written_table(df: DataFrame) -> DataFrame:
    """The same rows from a table in the checkpoint folder: unlike a checkpoint's, its size is known, so that Spark
    picks the join by it."""
    path = f"{_checkpoint_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="faultline-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()

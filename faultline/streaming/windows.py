"""Error counts per time window over a stream (or table) of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import stepflags
from faultline.functions.barrier import computed_once


def fingerprint_windows(steps: DataFrame, window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """``window_start, code, count`` of fingerprinted steps per tumbling window of ``ts``.

    With ``watermark`` the input may be a stream; rows later than that are dropped and a window is
    written once it is closed. The state holds one counter per open window and code.
    """
    rejected = steps.filter(stepflags.failed(*stepflags.STEP_COLUMNS)).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "obs_content")
    found = computed_once(rejected, _fp=F.expr(stepflags.fingerprint("obs_content")))
    found = found.filter(F.col("_fp").isNotNull()).withColumn("code", F.expr(stepflags.code_of("_fp")))
    if watermark:
        found = found.withWatermark("ts", watermark)
    counted = found.groupBy(F.window("ts", window), "code").agg(F.count("*").alias("count"))
    return counted.select(F.col("window.start").alias("window_start"), "code", "count")

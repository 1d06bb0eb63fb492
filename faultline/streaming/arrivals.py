"""Runs that arrive as files: classify each micro-batch, append its cards and one history row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.views import trend_row
from faultline.plans.classify import classify_runs
from faultline.schema import RUN_DDL, struct
from faultline.session import cut_lineage
from faultline.sources.seen import remember, unseen


def run_stream(spark: SparkSession, directory: str, pattern: str = "*.jsonl", files_per_batch: int = 1000) -> DataFrame:
    """A stream of complete runs, one JSON line each."""
    return (
        spark.readStream.schema(struct(RUN_DDL)).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).json(directory)
    )


def append_batches(
    runs: DataFrame, cards_path: str, trend_path: str, checkpoint: str, responses: DataFrame | None = None,
    trigger: dict | None = None, store: str | None = None,
) -> StreamingQuery:
    """Write cards and history of every micro-batch.

    With a ``store`` of content hashes, runs whose content an earlier batch has classified get no card.

    Both outputs are keyed by the batch number and overwrite only their own batch, so a batch that is
    repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        cards_of_batch = f"{cards_path}/batch={number}"
        if store is not None:
            batch = cut_lineage(unseen(batch, store, number))
        classify_runs(batch, responses, created_at=F.current_timestamp()).write.mode("overwrite").parquet(cards_of_batch)
        stored = batch.sparkSession.read.parquet(cards_of_batch)
        row = trend_row(stored, F.unix_micros(F.current_timestamp()) / 1e6)
        row.write.mode("overwrite").parquet(f"{trend_path}/batch={number}")
        if store is not None:
            remember(batch, store, number)

    return (
        runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )

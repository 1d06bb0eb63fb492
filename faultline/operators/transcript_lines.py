"""Chat transcripts of any length, as a table with one row per line.

A line that starts with "> " opens a block; the number of openers up to a line names its block. That count runs by
chunks of lines, one small row per chunk carries it on, so a transcript may hold any share of all lines. Only the
lines of one block, an action and what it printed, come together in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.sequence import join_by_chunk, with_ordinal, with_running_sum
from faultline.functions.text import LINE_BREAK, strip
from faultline.operators.normalize_sessions import AGENT, block_step
from faultline.session import cut_lineage

OPENER = "> "
CHUNK_ROWS = 4096


def transcript_line_steps(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``run_id, index, step`` from ``run_id, chunk, pos, line``.

    ``pos`` orders the lines of a run, each once; ``chunk`` must not fall along it. Lines before the first opener
    and blocks without an action are left out.
    """
    opens = F.col("line").startswith(OPENER).cast("long")
    counted = with_running_sum(lines, ["run_id"], "chunk", ["pos"], opens, "_before").withColumn("block", F.col("_before") + opens)
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    blocks = counted.filter("block > 0").groupBy("run_id", "block").agg(held.alias("held"))
    rest = F.slice("held", 2, F.greatest(F.size("held") - 1, F.lit(0)))
    blocks = cut_lineage(blocks.select(
        "run_id", "block", strip(F.substring(F.get("held", F.lit(0)), len(OPENER) + 1, 1 << 30)).alias("action"),
        strip(F.array_join(rest, "\n")).alias("seen")))
    counts = blocks.groupBy("run_id").agg(F.max("block").alias("n"))
    known = join_by_chunk(blocks.withColumn("place", F.col("block") - 1), counts, "run_id", "place", "n", chunk_rows)
    made = known.filter(F.length("action") > 0).select(
        "run_id", "chunk", "block", block_step(F.struct("action", "seen", (F.col("block") == F.col("n")).alias("is_last"))).alias("step"))
    return with_ordinal(made, ["run_id"], "chunk", ["block"]).select("run_id", "index", "step")


def read_transcript_lines(spark: SparkSession, path, chunk_bits: int = 12) -> DataFrame:
    """``run_id, chunk, pos, line`` of transcript files, one run per file, however the files are split."""
    rows = spark.read.text(path).select(
        F.concat(F.lit(f"{AGENT}-"), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")).alias("run_id"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    parts = rows.select("run_id", "block", "row", F.posexplode(F.split("value", LINE_BREAK)).alias("part", "line"))
    return parts.select(
        "run_id", F.struct("block", F.shiftright("row", chunk_bits).alias("row")).alias("chunk"),
        F.struct("block", "row", "part").alias("pos"), "line")

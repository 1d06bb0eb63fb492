"""Readers. Every reader names its schema; raw agent records stay VARIANT until a normalizer reads them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.barrier import computed_once
from faultline.functions.text import not_blank, strip
from faultline.operators.normalize_actions import normalize_action_lists
from faultline.operators.normalize_chats import normalize_chats
from faultline.operators.normalize_history import normalize_histories, normalize_sdk
from faultline.operators.normalize_sessions import normalize_sessions
from faultline.operators.steps import keep_failed, run_failed
from faultline.schema import CARD_DDL, GOLD_DDL, RESPONSE_DDL, RUN_DDL, struct
from faultline.sources.json_arrays import read_array_records
from faultline.taxonomy import is_code


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Normalized runs, one JSON document per line; a broken line fails the job."""
    return spark.read.schema(struct(RUN_DDL)).option("mode", "FAILFAST").json(path)


def read_run_document(spark: SparkSession, path: str) -> DataFrame:
    """Normalized runs, one (possibly indented) JSON document per file."""
    return spark.read.schema(struct(RUN_DDL)).option("mode", "FAILFAST").option("multiLine", True).json(path)


def _line_order() -> Column:
    """Place of a row of a file scan: file, block, and the row's number, which grows inside a block."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))


def _lenient(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Fields of ``ddl`` and ``seq`` of every line that is a whole JSON object; a mistyped field is null."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line"), _line_order().alias("seq"))
    parsed = computed_once(lines.filter(F.col("line").startswith("{")), record=j.parse_strict(F.col("line")))
    fields = F.from_json("line", struct(ddl)).alias("fields")
    return parsed.filter(F.col("record").isNotNull()).select(fields, "seq").select("fields.*", "seq")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Stored cards; blank and broken lines are skipped, missing and mistyped fields are null."""
    return _lenient(spark, path, CARD_DDL).drop("seq")


def read_labels(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``run_id`` and one label field of JSON-lines files, with ``seq`` telling the order by file and line."""
    return _lenient(spark, path, f"run_id STRING, `{field}` STRING")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(struct(RESPONSE_DDL)).option("mode", "FAILFAST").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold labels with ``seq`` telling the order by file and line. A label outside the taxonomy fails the job."""
    gold = spark.read.schema(struct(GOLD_DDL)).option("mode", "FAILFAST").json(path)
    return checked_gold(gold.select("*", _line_order().alias("seq")))


def checked_gold(gold: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("gold label for "), F.coalesce("run_id", F.lit("null")), F.lit(" has invalid category "),
        F.coalesce("true_category", F.lit("null")),
    )
    valid = F.when(is_code(F.col("true_category")), F.col("true_category")).otherwise(F.raise_error(message))
    return gold.withColumn("true_category", valid).fillna({"labeler": "unknown", "notes": ""})


def _record_lines(spark: SparkSession, paths) -> DataFrame:
    """One record per line that is a whole JSON object; blank and broken lines are dropped."""
    line = strip(F.col("value"))
    lines = spark.read.text(paths).select(line.alias("line")).filter(F.col("line").startswith("{"))
    parsed = computed_once(lines, record=j.parse_strict(F.col("line")))
    return parsed.filter(F.col("record").isNotNull()).select("record")


def _record_documents(spark: SparkSession, paths) -> DataFrame:
    """The records of whole files: an array's objects, or a single object. Broken files give no row."""
    value = j.parse_strict(F.col("value"))
    documents = computed_once(spark.read.text(paths, wholetext=True), value=value)
    items = F.when(j.is_array(F.col("value")), j.array_at(F.col("value"), "$")).otherwise(F.array("value"))
    return documents.filter(F.col("value").isNotNull()).select(F.explode(items).alias("record")).filter(
        j.is_object(F.col("record"))
    )


def read_raw_records(spark: SparkSession, path, layout: str) -> DataFrame:
    """``record VARIANT`` of files in one ``layout``: "lines" has one JSON object per line; "array" has one JSON
    array per file, which is split over tasks at any size; "document" has one JSON array or (indented) object per
    file, which one task reads whole."""
    if layout == "array":
        return read_array_records(spark, path).select("record")
    if layout == "lines":
        return _record_lines(spark, path)
    if layout == "document":
        return _record_documents(spark, path)
    raise ValueError(f"unknown layout: {layout}")


def read_action_lists(spark: SparkSession, path, layout: str) -> DataFrame:
    return normalize_action_lists(read_raw_records(spark, path, layout))


def read_sessions(spark: SparkSession, path, layout: str) -> DataFrame:
    return normalize_sessions(read_raw_records(spark, path, layout))


def read_chats(spark: SparkSession, path, layout: str) -> DataFrame:
    return normalize_chats(read_raw_records(spark, path, layout))


def _whole_files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    documents = spark.read.text(path, wholetext=True, pathGlobFilter=name)
    message = F.concat(F.lit("not a JSON document: "), F.col("_metadata.file_path"))
    parsed = j.parse_strict(F.col("value"))
    return documents.select(
        F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast("variant")).alias("record"),
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file_stem"),
    )


def read_sdk_traces(spark: SparkSession, directory: str) -> DataFrame:
    """One run per ``*.jsonl`` file of a trace directory."""
    return normalize_sdk(_whole_files(spark, directory, "*.jsonl"))


def read_history_document(spark: SparkSession, path: str) -> DataFrame:
    """One run per event-history document."""
    return normalize_histories(_whole_files(spark, path))


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``value`` and ``line`` of the lines that are not blank, numbered from 1 over all files in path order.

    Rows of one split are numbered by the scan itself; the counts of earlier splits shift them, so the numbers do not
    depend on how files are split and no line is shuffled.
    """
    lines = spark.read.text(path).filter(not_blank(F.col("value"))).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # One row of three numbers for each split: some tens of megabytes for a million splits.
    shifts = splits.select(
        F.xxhash64("file", "block").alias("split"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.withColumn("split", F.xxhash64("file", "block")).join(F.broadcast(shifts), "split").select(
        "value", (F.col("row") + F.col("shift")).alias("line"))


def ingest_histories(spark: SparkSession, path: str, all_runs: bool = False) -> DataFrame:
    """Runs from event-history batch files, one record per line; only the failed ones unless ``all_runs``. A broken
    line fails the job. A record without an id is named by the number of its line."""
    parsed = j.parse_strict(F.col("value"))
    records = _numbered_lines(spark, path).select(
        F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("not a JSON record")).cast("variant")).alias("record"),
        F.concat(F.lit("unknown-"), F.col("line").cast("string")).alias("unnamed"),
    )
    runs = normalize_histories(records, F.col("unnamed"), strict_null=True)
    return runs if all_runs else keep_failed(runs)


def ingest_to(spark: SparkSession, path: str, target: str, all_runs: bool = False) -> dict[str, int]:
    """Write the runs of ``ingest_histories`` as JSON lines and give ``total, written, skipped``, counted on the way."""
    seen = Observation("ingest")
    failed = run_failed(F.col("resolved"), F.col("test_result.passed"))
    kept = F.lit(True) if all_runs else failed
    runs = ingest_histories(spark, path, all_runs=True).observe(
        seen, F.count("*").alias("total"), F.count_if(kept).alias("written"), F.count_if(~kept).alias("skipped"))
    runs.filter(kept).write.mode("overwrite").json(target)
    return seen.get


def ingest_counts(runs: DataFrame) -> DataFrame:
    """``total, written, skipped`` of a batch read with ``all_runs``."""
    kept = F.coalesce(~F.col("resolved"), ~F.col("test_result.passed"), F.lit(False))
    return runs.agg(
        F.count("*").alias("total"), F.count_if(kept).alias("written"), F.count_if(~kept).alias("skipped")
    )


def union_runs(*frames: DataFrame) -> DataFrame:
    """Runs of all formats in one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

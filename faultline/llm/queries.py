"""The operators as registered queries over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import conversations, decontaminate, fingerprints, language_model, near_dedup, packing, pieces, quality, resampling
from faultline.llm import token_counts, token_files, toxicity, warc
from faultline.llm.common import documents, labels
from faultline.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(encoded, "doc_id")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.model_of(docs, labels(spark, sf_dir))
    return toxicity.predicted(toxicity.toxicity(docs, model), 0.7)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.model_of(docs, labels(spark, sf_dir))
    return toxicity.predicted(quality.quality(docs, model), 0.5)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, shuffle_width(spark))
    return token_files.digests(read)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_records(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.occurrences(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.hit_counts(found)


@query
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(documents(spark, sf_dir), 4 * shuffle_width(spark))
    return fingerprints.digests(found)


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resampling.resampled(documents(spark, sf_dir), target, shuffle_width(spark))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shuffle_width(spark))


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_rows(packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0))

"""Aggregate views over cards, and the batch history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.schema import CORRECTION_DDL, struct
from faultline.taxonomy import is_code, taxonomy, with_taxonomy


def category_distribution(cards: DataFrame) -> DataFrame:
    return cards.groupBy("primary_category").agg(F.count("*").alias("count"))


def owner_distribution(cards: DataFrame) -> DataFrame:
    return cards.groupBy("owner").agg(F.count("*").alias("count"))


def classifier_split(cards: DataFrame) -> DataFrame:
    return cards.groupBy("classifier").agg(F.count("*").alias("count"))


def _rate(condition: Column) -> Column:
    """Share of rows where the condition holds, four decimals, 0 for no rows."""
    return F.round(F.count_if(condition) / F.greatest(F.count("*"), F.lit(1)), 4)


def rule_rate(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("n"), _rate(F.col("classifier") == "rule").alias("rule_rate"))


def other_rate(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("n"), _rate(F.col("primary_category") == "OTHER").alias("other_rate"))


def average_confidence(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("average_confidence"))


def calibration_view(cards: DataFrame) -> DataFrame:
    """Distribution, classifier split and OTHER rate in one pass:
    ``dimension`` is category, classifier or total. The total row counts at least 1."""
    # The pair counts are at most categories x classifiers rows; the grouping sets expand only these.
    pairs = cards.groupBy("primary_category", "classifier").agg(F.count("*").alias("count"))
    sets = pairs.groupingSets(
        [["primary_category"], ["classifier"], []], "primary_category", "classifier"
    ).agg(
        F.sum("count").alias("count"),
        F.sum(F.when(F.col("primary_category") == "OTHER", F.col("count")).otherwise(0)).alias("other"),
        F.grouping("primary_category").alias("_gp"), F.grouping("classifier").alias("_gc"),
    )
    is_total = (F.col("_gp") == 1) & (F.col("_gc") == 1)
    return sets.select(
        F.when(is_total, "total").when(F.col("_gp") == 0, "category").otherwise("classifier").alias("dimension"),
        F.when(is_total, "all").otherwise(F.coalesce("primary_category", "classifier")).alias("value"),
        F.when(is_total, F.greatest(F.coalesce("count", F.lit(0)), F.lit(1))).otherwise(F.col("count")).alias("count"),
        F.when(is_total, F.round(F.coalesce("other", F.lit(0)) / F.greatest(F.coalesce("count", F.lit(0)), F.lit(1)), 4))
        .alias("other_rate"),
    )


def summary_tiles(cards: DataFrame) -> DataFrame:
    """Head figures of a batch: size, escalations to the agent framework, rule share, modes, owners."""
    owned = with_taxonomy(cards.select("primary_category", "classifier"), "primary_category", "owner")
    share = F.count_if(F.col("classifier") == "rule") / F.greatest(F.count("*"), F.lit(1)) * 100
    return owned.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("owner") == "agent_framework").alias("escalations"),
        F.floor(share + 0.5).alias("rule_share_percent"),
        F.count_distinct("primary_category").alias("distinct_modes"),
        F.count_distinct("owner").alias("owners_seen"),
    )


def zero_filled_distribution(cards: DataFrame) -> DataFrame:
    """Every taxonomy code in order with its count and its bar length in percent of the largest."""
    counts = category_distribution(cards)
    dim = taxonomy(cards.sparkSession, ("position", "code", "owner")).withColumnRenamed("code", "primary_category")
    filled = F.broadcast(dim).join(counts, "primary_category", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # Ten rows: the unpartitioned window is bounded by the taxonomy.
    largest = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return filled.select(
        "position", "primary_category", "owner", "count", F.round(F.col("count") / largest * 100, 4).alias("bar_percent")
    )


def stored_distribution(cards: DataFrame) -> DataFrame:
    """Distribution of stored cards that may lack keys."""
    return (
        cards.groupBy(
            F.coalesce("primary_category", F.lit("UNKNOWN")).alias("primary_category"),
            F.coalesce("owner", F.lit("unknown")).alias("owner"),
        ).agg(F.count("*").alias("count"))
    )


def version_pivot(cards: DataFrame, version: str, versions: list[str]) -> DataFrame:
    """Categories against versions; absent pairs count 0. The versions are given, so no pass is spent
    on finding them."""
    wide = cards.groupBy("primary_category").pivot(version, versions).agg(F.count(F.lit(1)))
    return wide.select("primary_category", *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in versions])


# ---------------------------------------------------------------------------------------------
# History tables


def _counts_json(name: str) -> Column:
    """Sorted JSON object of the (key, count) pairs collected under ``name``."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("dimension") == name, F.struct("value", "count"))))
    return F.coalesce(F.to_json(F.map_from_entries(pairs)), F.lit("{}"))


def trend_row(cards: DataFrame, ts: Column, by: list[str] | None = None) -> DataFrame:
    """One history row per batch: ``ts, count, distribution, owner_distribution, rule_rate``.

    The collected lists hold one entry per category or owner, which the taxonomy bounds.
    """
    by = by or []
    pairs = cards.groupBy(*by, "primary_category", "owner", "classifier").agg(F.count("*").alias("count"))
    stacked = pairs.select(
        *by, "classifier", "count",
        F.explode(F.array(
            F.struct(F.lit("category").alias("dimension"), F.col("primary_category").alias("value")),
            F.struct(F.lit("owner").alias("dimension"), F.col("owner").alias("value")),
        )).alias("d"),
    ).select(*by, "classifier", "count", "d.*")
    per_value = stacked.groupBy(*by, "dimension", "value").agg(
        F.sum("count").alias("count"),
        F.sum(F.when(F.col("classifier") == "rule", F.col("count")).otherwise(0)).alias("rules"),
    )
    in_category = F.col("dimension") == "category"
    row = per_value.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(in_category, F.col("count"))), F.lit(0)).alias("n"),
        _counts_json("category").alias("distribution"),
        _counts_json("owner").alias("owner_distribution"),
        F.coalesce(F.sum(F.when(in_category, F.col("rules"))), F.lit(0)).alias("rules"),
    )
    return row.select(
        *by, ts.cast("double").alias("ts"), F.col("n").alias("count"), "distribution", "owner_distribution",
        F.round(F.col("rules") / F.greatest("n", F.lit(1)), 4).alias("rule_rate"),
    )


def latest_trend(trend: DataFrame, limit: int = 50) -> DataFrame:
    """The newest batches, as many as asked for."""
    return trend.orderBy(F.desc("ts")).limit(limit)


def trend_size(trend: DataFrame) -> DataFrame:
    """How many batches are recorded in all (not only on the page shown)."""
    return trend.agg(F.count("*").alias("total_batches_recorded"))


def correction_rows(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Correction rows to append from ``run_id, true_label, note, created_at``. The label is upper-cased
    and must be a taxonomy code, else the job fails; ``auto_label`` is the card's category."""
    label = F.upper("true_label")
    bad = F.concat(F.lit("unknown taxonomy code: "), F.coalesce("true_label", F.lit("null")))
    checked = requests.withColumn("true_label", F.when(is_code(label), label).otherwise(F.raise_error(bad)))
    known = cards.select("run_id", F.col("primary_category").alias("auto_label"))
    joined = checked.join(known, "run_id", "left")
    return joined.select(
        "run_id", F.coalesce("auto_label", F.lit("unknown")).alias("auto_label"), "true_label", "note",
        F.col("created_at").cast("double").alias("created_at"),
    ).to(struct(CORRECTION_DDL))


def latest_corrections(corrections: DataFrame, limit: int = 100) -> DataFrame:
    """The newest corrections, as many as asked for."""
    return corrections.orderBy(F.desc("created_at")).limit(limit)

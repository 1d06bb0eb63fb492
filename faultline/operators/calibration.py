"""Confidence calibration: Platt scaling and the reliability table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.arrays import let

LEARNING_RATE, STEPS = 0.1, 200
DIGITS = 4
BINS = 5


def sigmoid(x: Column) -> Column:
    """Logistic function that does not overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def fit_platt(pairs: DataFrame, lr: float = LEARNING_RATE, steps: int = STEPS, digits: int = DIGITS) -> DataFrame:
    """One row ``a, b, n`` such that P(correct) = sigmoid(a * confidence + b).

    Confidences are rounded to ``digits`` decimals, so rows shrink to at most 10^digits + 1 groups whatever their
    number, with row count ``n`` and hits ``k``; equal confidences share their gradient. All steps fold that list in
    one expression of one job.
    """
    x = F.round("confidence", digits)
    groups = pairs.filter(F.col("confidence").isNotNull()).groupBy(x.alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.count_if("correct").cast("double").alias("k"))
    listed = groups.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("x", "n", "k"))).alias("groups"))

    def moved(fit: Column, _: Column) -> Column:
        def added(total: Column, g: Column) -> Column:
            error = g["n"] * sigmoid(fit["a"] * g["x"] + fit["b"]) - g["k"]
            return F.struct((total["da"] + error * g["x"]).alias("da"), (total["db"] + error).alias("db"))

        zero = F.struct(F.lit(0.0).alias("da"), F.lit(0.0).alias("db"))
        return let(F.aggregate("groups", zero, added), lambda d: F.struct(
            (fit["a"] - lr * d["da"] / F.col("n")).alias("a"), (fit["b"] - lr * d["db"] / F.col("n")).alias("b")))

    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    fitted = listed.select("n", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, moved).alias("fit")).first()
    if fitted["n"] is None or fitted["n"] < 2:
        raise ValueError("need at least two rows to fit a calibration")
    return pairs.sparkSession.createDataFrame([(*fitted["fit"], int(fitted["n"]))], "a DOUBLE, b DOUBLE, n BIGINT")


def calibrate(scores: DataFrame, parameters: DataFrame, column: str = "confidence") -> DataFrame:
    """Add ``calibrated``; ``parameters`` is the one-row table of ``fit_platt``."""
    fitted = scores.withColumn("_fit", parameters.select(F.struct("a", "b")).scalar())
    line = F.col("_fit.a") * F.col(column) + F.col("_fit.b")
    return fitted.withColumn("calibrated", sigmoid(line)).drop("_fit")


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Bin number from the same double products as the edges ``i * width``; 1.0 and above has no bin."""
    width = 1.0 / bins
    case = None
    for i in range(bins):
        inside = (confidence >= i * width) & (confidence < (i + 1) * width)
        case = F.when(inside, i) if case is None else case.when(inside, i)
    return case


def _per_bin(pairs: DataFrame, bins: int) -> DataFrame:
    """One row per bin; rows that have no bin count under a null one."""
    binned = pairs.select(bin_of(F.col("confidence"), bins).alias("bin"), "confidence", "correct")
    return binned.groupBy("bin").agg(
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
        F.count("*").alias("count"),
    )


def reliability(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """Non-empty bins: ``bin, bin_mid, mean_confidence, accuracy, count, gap, marker``."""
    width = 1.0 / bins
    mid = F.array(*[F.lit((i * width + (i + 1) * width) / 2) for i in range(bins)])[F.col("bin")]
    gap = F.col("mean_confidence") - F.col("accuracy")
    return _per_bin(pairs, bins).filter(F.col("bin").isNotNull()).select(
        "bin", mid.alias("bin_mid"), "mean_confidence", "accuracy", "count", gap.alias("gap"),
        F.when(gap > 0.05, "▲").when(gap < -0.05, "▼").otherwise("≈").alias("marker"),
    )


def calibration_error(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """``ece`` (weighted by count, divided by all rows, binned or not) and ``mce``."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("mean_confidence") - F.col("accuracy")))
    sums = _per_bin(pairs, bins).agg(
        F.coalesce(F.sum(gap * F.col("count")), F.lit(0.0)).alias("weighted"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("mce"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"),
    )
    return sums.select(
        F.round(F.when(F.col("n") > 0, F.col("weighted") / F.col("n")).otherwise(0.0), 4).alias("ece"),
        F.round("mce", 4).alias("mce"), "n",
    )

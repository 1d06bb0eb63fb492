"""Agreement between labels: accuracy, kappa, per-class scores, intervals, disagreements.

Everything beyond the detail rows is computed from the confusion cells, at most labels x labels rows,
which one partially aggregated pass over the pairs yields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.sequence import with_ordinal
from faultline.functions.text import strip
from faultline.session import cut_lineage, written_table

MIN_OVERLAP = 5
ITERATIONS, ALPHA, SEED = 1000, 0.05, 42
SLOT = 32  # row numbers that are looked up together
BLOCK = 64  # row numbers that one row of work stands for


def latest_gold(gold: DataFrame, order: str) -> DataFrame:
    """One label per run: the last one by ``order`` wins."""
    return gold.groupBy("run_id").agg(F.max_by("true_category", order).alias("true_category"))


def details(cards: DataFrame, gold: DataFrame, order: str) -> DataFrame:
    """Cards with ground truth: ``run_id, task_id, true, predicted, correct, confidence, classifier``."""
    joined = cards.join(latest_gold(gold, order).select("run_id", "true_category"), "run_id")
    return joined.select(
        "run_id", "task_id", F.col("true_category").alias("true"), F.col("primary_category").alias("predicted"),
        (F.col("true_category") == F.col("primary_category")).alias("correct"), "confidence", "classifier",
    )


def cells(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion cells ``true, predicted, n`` of label pairs, optionally per group."""
    return pairs.groupBy(*(by or []), "true", "predicted").agg(F.count("*").alias("n"))


def _marginals(cell: DataFrame, by: list[str]) -> DataFrame:
    """Per label: its count as truth and as prediction, and where both agree."""
    sides = cell.select(
        *by, F.explode(F.array(
            F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                     F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0).alias("both")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                     F.lit(0).cast("long").alias("both")),
        )).alias("s"),
    ).select(*by, "s.*")
    return sides.groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("both").alias("both"))


def _kappa(observed: Column, expected: Column) -> Column:
    return F.when(expected >= 1.0, 1.0).otherwise((observed - expected) / (1.0 - expected))


def agreement(pairs: DataFrame, by: list[str] | None = None, empty_kappa: float = 0.0) -> DataFrame:
    """``n, n_agree, accuracy, kappa``, optionally per group. Without groups an empty input gives one
    row with accuracy 0 and ``empty_kappa``."""
    return cell_agreement(cells(pairs, by), by or [], empty_kappa)


def cell_agreement(cell: DataFrame, by: list[str], empty_kappa: float = 0.0) -> DataFrame:
    """``agreement`` from confusion cells ``true, predicted, n``."""
    labels = _marginals(cell, by)
    totals = labels.groupBy(*by).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum("both"), F.lit(0)).alias("n_agree"),
        F.coalesce(F.sum(F.col("t").cast("double") * F.col("p")), F.lit(0.0)).alias("products"),
    )
    n = F.col("n")
    observed, expected = F.col("n_agree") / n, F.col("products") / (n.cast("double") * n)
    return totals.select(
        *by, "n", "n_agree",
        F.when(n == 0, 0.0).otherwise(observed).alias("accuracy"),
        F.when(n == 0, F.lit(empty_kappa)).otherwise(_kappa(observed, expected)).alias("kappa"),
    )


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 on a zero denominator."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(0.0)

    scored = _marginals(cells(pairs), []).select(
        "label", ratio(F.col("both"), F.col("p")).alias("precision"),
        ratio(F.col("both"), F.col("t")).alias("recall"), F.col("t").alias("support"),
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))


def confusion(pairs: DataFrame) -> DataFrame:
    """Every label against every label, zero-filled. The grid is built from the distinct labels of the
    cells; the two sides have at most one row per label."""
    cell = cells(pairs)
    labels = _marginals(cell, []).select("label")
    # The grid pairs distinct labels, never rows: its size is the square of the label count.
    grid = labels.agg(F.collect_set("label").alias("labels")).select(
        F.explode("labels").alias("true"), F.col("labels").alias("_all")
    ).select("true", F.explode("_all").alias("predicted"))
    return grid.join(cell, ["true", "predicted"], "left").select(
        "true", "predicted", F.coalesce("n", F.lit(0)).alias("count")
    )


def _numbered_cells(pairs: DataFrame) -> DataFrame:
    """Confusion cells with the stretch ``low <= i < high`` of row numbers each stands for.

    Cells are ordered inside buckets by a hash of their labels and buckets by number, so that free-text labels of
    any variety are numbered in parallel; only the buckets' totals meet in one task.
    """
    bucket = F.substring(F.md5(F.concat_ws("|", "true", "predicted")), 1, 2)
    cell = cut_lineage(cells(pairs).withColumn("bucket", bucket))
    totals = cell.groupBy("bucket").agg(F.sum("n").alias("_n"))
    starts = totals.select("bucket", (F.sum("_n").over(Window.orderBy("bucket")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("bucket").orderBy("true", "predicted")
    high = F.col("_start") + F.sum("n").over(inside)
    return cell.join(starts, "bucket").withColumn("high", high).withColumn("low", F.col("high") - F.col("n")).select(
        "true", "predicted", "n", "low", "high")


def resampled_cells(pairs: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """``replicate, true, predicted, n``: confusion cells of resamples with replacement.

    Draw ``i`` of replicate ``b`` is the row numbered md5(``seed:b:i``) (its first 32 bits) modulo the number of
    rows, so any engine and any task draws the same. Row numbers belong to cells, not to rows: a draw is looked up in
    the few cells of its slot of ``SLOT`` numbers, and draws are counted per replicate and cell before a shuffle.
    """
    own = _numbered_cells(pairs)
    total = own.select(F.sum("n")).scalar()
    spark = pairs.sparkSession
    # Stretches of numbers, dealt evenly whatever the cells' sizes.
    blocks = own.select(F.explode(F.sequence("low", F.col("high") - 1, F.lit(BLOCK).cast("long"))).alias("begin"), "high")
    blocks = blocks.repartition(4 * spark.sparkContext.defaultParallelism, "begin")
    numbers = blocks.select(F.explode(F.sequence("begin", F.least(F.col("begin") + BLOCK, F.col("high")) - 1)).alias("i"))
    draws = numbers.select(F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("replicate"), "i")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate"), F.col("i"))), 1, 8), 16, 10).cast("long") % total
    draws = draws.select("replicate", drawn.alias("row")).withColumn("slot", F.floor(F.col("row") / SLOT))
    slots = own.select(
        "true", "predicted", "low",
        F.explode(F.sequence(F.floor(F.col("low") / SLOT), F.floor((F.col("high") - 1) / SLOT))).alias("slot"))
    # A slot has at most as many cells as numbers.
    slots = written_table(slots.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("low", "true", "predicted"))).alias("cells")))
    found = draws.join(slots, "slot").select(
        "replicate", F.element_at(F.filter("cells", lambda c: c["low"] <= F.col("row")), -1).alias("cell"))
    return found.groupBy("replicate", F.col("cell.true").alias("true"), F.col("cell.predicted").alias("predicted")).agg(F.count("*").alias("n"))


def accuracy_and_kappa(cell: DataFrame, by: list[str]) -> DataFrame:
    return cell_agreement(cell, by).drop("n", "n_agree")


#: From confusion cells, per group: a row with the group's columns and a number in every other column.
Statistic = Callable[[DataFrame, list[str]], DataFrame]


def bootstrap_statistics(
    pairs: DataFrame, statistic: Statistic = accuracy_and_kappa, iterations: int = ITERATIONS, seed: int = SEED
) -> DataFrame:
    """``replicate`` and the columns of any ``statistic`` for each resample."""
    return statistic(resampled_cells(pairs, iterations, seed), ["replicate"])


def bootstrap_interval(
    pairs: DataFrame, iterations: int = ITERATIONS, alpha: float = ALPHA, seed: int = SEED,
    upper_shift: int = -1, statistic: Statistic = accuracy_and_kappa,
) -> DataFrame:
    """One row with ``{name}_low`` and ``{name}_high`` of every number of the statistic; 0 without rows.

    ``upper_shift`` is -1 for evaluation reports and 0 for annotator reports, which take the next higher order
    statistic.
    """
    low = int((alpha / 2) * iterations)
    high = int((1 - alpha / 2) * iterations) + upper_shift
    stats = bootstrap_statistics(pairs, statistic, iterations, seed)
    names = [c for c in stats.columns if c != "replicate"]
    # One value per replicate, so the sorted arrays hold ``iterations`` numbers.
    sorted_values = stats.agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in names])
    return sorted_values.select(*[
        F.coalesce(F.get(F.col(c), F.lit(at)), F.lit(0.0)).alias(f"{c}_{side}") for c in names for side, at in (("low", low), ("high", high))
    ])


def report(pairs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The one-row evaluation report, rounded to four decimals."""
    numbers = agreement(pairs).select("n", F.round("accuracy", 4).alias("accuracy"), F.round("kappa", 4).alias("kappa"))
    interval = bootstrap_interval(pairs, iterations)
    bounds = interval.select(F.struct(*[F.round(c, 4).alias(c) for c in interval.columns]))
    return numbers.withColumn("_bounds", bounds.scalar()).select("*", "_bounds.*").drop("_bounds")


def half_split(pairs: DataFrame, key: str = "run_id", seed: int = SEED) -> DataFrame:
    """Mark each row half 1 or 2 after ordering by a seeded digest; the first half takes the odd row.

    The digest's first four digits are an order-preserving bucket of at most 65,536 values, so the
    global rank needs no global sort.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    ranked = with_ordinal(
        pairs.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 4)),
        [], "_bucket", ["_digest"], "_rank",
    )
    total = pairs.agg(F.count("*")).scalar()
    half = F.when(F.col("_rank") < F.ceil(total / 2), 1).otherwise(2)
    return ranked.withColumn("half", half).drop("_digest", "_bucket", "_rank")


# ---------------------------------------------------------------------------------------------
# Annotators


def load_labels(table: DataFrame, field: str, order: str) -> DataFrame:
    """``run_id, label`` with labels stripped and upper-cased; empty ones dropped, the last by ``order`` wins."""
    kept = table.filter((F.length("run_id") > 0) & (F.length(F.col(field).cast("string")) > 0))
    label = F.upper(strip(F.col(field).cast("string")))
    return kept.groupBy("run_id").agg(F.max_by(label, order).alias("label"))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Runs both annotators labelled, as pairs."""
    return first.withColumnRenamed("label", "true").join(second.withColumnRenamed("label", "predicted"), "run_id")


def annotator_agreement(first: DataFrame, second: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Raw agreement, kappa and its reading; ``enough_overlap`` tells whether ``min_overlap`` runs are shared.
    Without any shared run there is no percentage, kappa or reading."""
    numbers = agreement(overlap(first, second), empty_kappa=float("nan"))
    k, some = F.col("kappa"), F.col("n") > 0
    band = F.when(k >= 0.80, "Strong").when(k >= 0.60, "Moderate").when(k >= 0.40, "Fair").otherwise("Poor")
    return numbers.select(
        "n", "n_agree", F.round(F.try_divide(F.col("n_agree"), F.col("n")) * 100, 1).alias("percent"),
        F.when(some, F.round(k, 4)).alias("kappa"), F.when(some, band).alias("band"),
        (F.col("n") >= min_overlap).alias("enough_overlap"),
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("true") != F.col("predicted"))


def disagreement_pairs(pairs: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent ordered pairs of differing labels."""
    counted = disagreements(pairs).groupBy("true", "predicted").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "true", "predicted").limit(top)


def label_queue(cards: DataFrame, gold: DataFrame, n: int = 10, order: str = "run_id") -> DataFrame:
    """The next ``n`` cards nobody labelled yet."""
    open_cards = cards.join(gold.select("run_id"), "run_id", "left_anti")
    return open_cards.orderBy(order).limit(n)

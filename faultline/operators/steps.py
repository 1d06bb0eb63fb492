"""Run and step predicates, and the step views of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import stepflags
from faultline.functions.barrier import computed_once
from faultline.functions.text import not_blank, occurrences


_NESTED_FAILED = stepflags.failed("s.action_type", "s.observation IS NOT NULL", "s.observation.exit_code")


def produced_patch(patch: Column) -> Column:
    return not_blank(patch)


def catastrophic_edit(patch: Column) -> Column:
    """The patch removes more than ten lines and adds fewer than 30 % of that (headers count too)."""
    removed, added = occurrences(patch, "\n-"), occurrences(patch, "\n+")
    return F.coalesce((removed > 10) & (added < removed * F.lit(0.3)), F.lit(False))


def run_failed(resolved: Column, passed: Column) -> Column:
    """Unresolved, or with no ground truth not passed, or with no test result either: not failed."""
    return F.coalesce(~resolved, ~passed, F.lit(False))


def content_hash(task_id: Column, agent: Column, model: Column, patch: Column, step_count: Column) -> Column:
    """Stable 16-digit hash of a run's salient content, for deduplication and caching."""
    parts = [task_id, agent, F.coalesce(model, F.lit("")), F.coalesce(patch, F.lit("")), step_count.cast("string")]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def with_run_facts(runs: DataFrame) -> DataFrame:
    """Add ``step_count``, ``produced_patch``, ``failed`` and ``content_hash`` to nested runs."""
    return (
        runs.withColumn("step_count", F.coalesce(F.size("steps"), F.lit(0)))
        .withColumn("step_count", F.greatest("step_count", F.lit(0)))
        .withColumn("produced_patch", produced_patch(F.col("final_patch")))
        .withColumn("failed", run_failed(F.col("resolved"), F.col("test_result.passed")))
        .withColumn(
            "content_hash",
            content_hash(
                F.col("task.task_id"), F.col("agent"), F.col("model"), F.col("final_patch"), F.col("step_count")
            ),
        )
    )


def drop_duplicate_content(runs: DataFrame) -> DataFrame:
    """Keep one run per content hash."""
    return runs.dropDuplicates(["content_hash"])


def keep_failed(runs: DataFrame) -> DataFrame:
    return runs.filter(run_failed(F.col("resolved"), F.col("test_result.passed")))


def failed_steps(steps: str = "steps") -> Column:
    """The rejected steps of a nested run, in order."""
    return F.expr(f"filter({steps}, s -> {_NESTED_FAILED})")


def last_steps(steps: Column, n: int = 5) -> Column:
    """The last ``n`` steps of a nested run, in order."""
    size = F.size(steps)
    return F.slice(steps, F.greatest(size - n, F.lit(0)) + 1, F.lit(n))


def with_step_failed(steps: DataFrame) -> DataFrame:
    """Add ``failed`` to a steps table."""
    return steps.withColumn("failed", F.expr(stepflags.failed(*stepflags.STEP_COLUMNS)))


def last_step_rows(steps: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` rows per run of a steps table. Each task keeps at most ``n`` rows per run before
    the shuffle, so a long run does not gather in one place."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("index"))
    return steps.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def steps_table(runs: DataFrame) -> DataFrame:
    """Flatten nested runs into one row per step; ``index`` is the step's position in the run."""
    # The explode brings a filter on the size of ``steps``, which must not take a copy of their expression along.
    once = computed_once(runs.select("run_id", "steps"), steps=F.col("steps"))
    return once.select("run_id", F.posexplode("steps").alias("pos", "step")).select(
        "run_id",
        F.col("pos").cast("long").alias("index"),
        F.col("step.action_type").alias("action_type"),
        F.col("step.content").alias("content"),
        F.col("step.observation.content").alias("obs_content"),
        F.col("step.observation.exit_code").alias("exit_code"),
        F.col("step.observation").isNotNull().alias("has_obs"),
    )

"""Agent runs derived from a generic event table.

Each user's week of events is read as one agent run and each event as one step. The mapping is the
contract between the sample tables and the run model; it is plain column arithmetic, so its work
grows with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.sequence import with_ordinal
from faultline.operators.rules import apply_rules
from faultline.operators.signals import signals_from_steps
from faultline.taxonomy import CODES


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "ts", "user_id", "event_type", "from_json(props, 'k INT').k AS k",
        "user_id * 8 + (day(ts) - 1) DIV 7 AS rk",
    )


RUN_ID = "concat('run-', rk)"

_ACTION = """CASE WHEN event_type = 'view' THEN 'file_read'
  WHEN event_type = 'purchase' AND k < 25 AND rk % 3 <> 0 THEN 'file_edit'
  WHEN event_type = 'signup' AND k < 20 THEN 'finish'
  WHEN event_type = 'signup' THEN 'message'
  WHEN event_type = 'error' AND k < 5 THEN 'error'
  ELSE 'command' END"""

_CONTENT = """CASE WHEN action_type = 'file_read' THEN concat('open src/mod_', k % 4, '.py')
  WHEN action_type = 'file_edit' THEN concat('edit src/mod_', k % 4, '.py')
  WHEN action_type <> 'command' THEN action_type
  WHEN k % 5 = 0 THEN concat('pytest tests/test_', k % 3)
  WHEN k % 5 = 1 THEN 'python runtests.py app'
  WHEN k % 5 = 2 THEN 'grep -rn foo src'
  WHEN k % 5 = 3 THEN 'make build'
  ELSE 'git status' END"""

_OBSERVATION = """CASE WHEN action_type IN ('message', 'finish') THEN NULL
  WHEN event_type <> 'error' THEN if(action_type = 'command' AND k % 5 = 0, '3 passed', 'ok')
  WHEN k < 3 THEN 'Error 429 rate limit exceeded'
  WHEN k < 6 THEN 'maximum iterations reached'
  WHEN k < 12 THEN 'ModuleNotFoundError: No module named foo'
  WHEN k < 20 THEN 'bash: python: command not found'
  WHEN k < 26 THEN 'patch does not apply'
  WHEN k < 40 THEN 'AssertionError: expected 1 but got 2'
  WHEN k < 48 THEN 'No such file or directory'
  ELSE '1 failed' END"""

_EXIT_CODE = """CASE WHEN action_type IN ('message', 'finish') THEN NULL
  WHEN event_type = 'error' THEN 1 ELSE 0 END"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps table: ``run_id, index, action_type, content, obs_content, exit_code, has_obs, ts``.

    A run covers seven days, so the minute of its event is an order-preserving bucket with at most
    10,080 values per run.
    """
    events = _events(spark, sf_dir).selectExpr("*", "day(ts) * 1440 + hour(ts) * 60 + minute(ts) AS minute")
    ordered = with_ordinal(events, ["rk"], "minute", ["ts", "event_id"])
    typed = ordered.selectExpr("*", f"{_ACTION} AS action_type")
    return typed.selectExpr(
        f"{RUN_ID} AS run_id", "index", "action_type", f"{_CONTENT} AS content", f"{_OBSERVATION} AS obs_content",
        f"{_EXIT_CODE} AS exit_code", "action_type NOT IN ('message', 'finish') AS has_obs", "ts",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run with its own columns (no steps)."""
    own = _events(spark, sf_dir).groupBy("rk").agg(
        F.expr("count(*) AS n_steps"), F.expr("min(user_id) AS user_id"), F.expr("max(ts) AS ended_at")
    )
    return own.selectExpr(
        "rk", f"{RUN_ID} AS run_id", "concat('task-', user_id) AS task_id",
        "if(rk % 2 = 0, 'openhands', 'swe-agent') AS agent",
        "if(rk % 3 <> 0, concat('model-', rk % 3), NULL) AS model",
        "if(rk % 5 <> 0, concat('org/repo-', rk % 5), NULL) AS repo",
        "concat('Fix issue ', repeat(concat(rk, ' '), CAST(rk % 400 AS INT))) AS problem_statement",
        r"""CASE WHEN rk % 20 = 1 THEN concat('diff --git a/src/mod.py b/src/mod.py', repeat('\n-x', 12))
                 WHEN rk % 4 = 1 THEN 'diff --git a/src/mod.py b/src/mod.py\n-x\n+y' END AS final_patch""",
        "if(rk % 4 <> 0, rk % 4 = 1, NULL) AS test_passed",
        "if(rk % 4 <> 0, rk % 9 + 4, NULL) AS total_tests", "if(rk % 4 = 1, rk % 9 + 4, NULL) AS passed_tests",
        "if(rk % 4 = 2, rk % 3, NULL) AS failed_tests",
        r"if(rk % 4 <> 0 AND rk % 5 < 3, concat('log of ', rk, repeat('\nran', CAST(rk % 300 AS INT))), '') AS raw_log",
        "if(rk % 7 = 0, rk % 14 = 0, NULL) AS resolved",
        "if(rk % 50 = 3, 'RuntimeError: agent crashed', NULL) AS error",
        "n_steps", "ended_at",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_from_steps(steps(spark, sf_dir), runs(spark, sf_dir))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals plus the rule that decides each run, without the rationale."""
    return apply_rules(signals(spark, sf_dir))


def gold(decided_runs: DataFrame) -> DataFrame:
    """Human labels: the rule's code for seven runs in ten, another code for the rest."""
    rk = F.substring_index("run_id", "-", -1).cast("long")
    other = F.array(*[F.lit(c) for c in CODES])[(rk % 10).cast("int")]
    label = F.when((rk * 7919) % 10 < 7, F.coalesce("rule_code", F.lit("OTHER"))).otherwise(other)
    return decided_runs.select(
        "run_id", "task_id", label.alias("true_category"), F.lit("sample").alias("labeler"), rk.alias("seq")
    )

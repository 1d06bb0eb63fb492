"""Explicit schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql.types import StructType

OBSERVATION = "STRUCT<content: STRING, exit_code: INT, truncated: BOOLEAN, extra: MAP<STRING, STRING>>"

STEP = (
    f"STRUCT<index: INT, action_type: STRING, content: STRING, observation: {OBSERVATION}, "
    "timestamp: TIMESTAMP, metadata: MAP<STRING, STRING>>"
)

TASK = (
    "STRUCT<task_id: STRING, source: STRING, repo: STRING, base_commit: STRING, problem_statement: STRING, "
    "gold_patch: STRING, test_directives: ARRAY<STRING>>"
)

TEST_RESULT = (
    "STRUCT<passed: BOOLEAN, total_tests: INT, passed_tests: INT, failed_tests: INT, error_tests: INT, "
    "raw_log: STRING>"
)

# One agent run per row, its steps nested in order.
RUN_DDL = (
    f"run_id STRING, agent STRING, model STRING, task {TASK}, steps ARRAY<{STEP}>, final_patch STRING, "
    f"test_result {TEST_RESULT}, resolved BOOLEAN, wall_time_seconds DOUBLE, total_tokens BIGINT, "
    "total_cost_usd DOUBLE, error STRING, metadata MAP<STRING, STRING>"
)

EVIDENCE = "STRUCT<step_index: INT, excerpt: STRING, why: STRING>"
CATEGORY_SCORE = "STRUCT<category: STRING, confidence: DOUBLE, source: STRING>"

CARD_DDL = (
    "run_id STRING, task_id STRING, agent STRING, model STRING, primary_category STRING, "
    "secondary_category STRING, confidence DOUBLE, classifier STRING, "
    f"all_categories ARRAY<{CATEGORY_SCORE}>, human_label STRING, human_note STRING, root_cause STRING, "
    f"evidence ARRAY<{EVIDENCE}>, owner STRING, recommended_action STRING, prevention STRING, "
    "fix_suggestion STRING, taxonomy_version STRING, provider STRING, created_at TIMESTAMP"
)

GOLD_DDL = "run_id STRING, task_id STRING, true_category STRING, labeler STRING, notes STRING"
RESPONSE_DDL = "run_id STRING, text STRING"
TREND_DDL = "ts DOUBLE, count BIGINT, distribution STRING, owner_distribution STRING, rule_rate DOUBLE"
CORRECTION_DDL = "run_id STRING, auto_label STRING, true_label STRING, note STRING, created_at DOUBLE"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)

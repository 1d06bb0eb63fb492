"""The ordered rule cascade: signals in, ``(rule_id, code, confidence, rationale)`` or null out.

The cascade is one CASE expression, so the first rule that holds wins and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.barrier import computed_once
from faultline.functions.sqltext import quoted


@dataclass(frozen=True)
class Rule:
    """``when`` is a condition over the signals; ``rationale`` alternates fixed text and expressions
    (marked by braces)."""

    rule_id: str
    code: str
    confidence: float
    when: str
    rationale: str


# Codes, confidences, thresholds and wording, most certain rule first.
RULES = [
    Rule("E1", "TOOL_USE", 0.78, "catastrophic_edit",
         "Catastrophic file edit: patch removes >70% more content than it adds. The edit deleted critical code "
         "(imports, classes, functions) instead of modifying the target logic."),
    Rule("E2", "INFRA_ERROR", 0.85, "size(infra_labels) > 0 AND NOT produced_patch",
         "Platform error fingerprint(s): {array_join(infra_labels, ', ')}; no patch produced."),
    Rule("E3", "RESOURCE_LIMIT", 0.80, "hit_resource_limit",
         "Resource-limit fingerprint(s): {array_join(resource_labels, ', ')}."),
    Rule("E4", "TOOL_USE", 0.72, "size(tool_labels) > 0 AND NOT no_file_edits AND NOT produced_patch",
         "Tool-use fingerprint(s) after file edit: {array_join(tool_labels, ', ')}; edit likely corrupted the "
         "target file (syntax error or patch failure)."),
    Rule("E5", "TOOL_USE", 0.65, "size(late_command_labels) > 0 AND no_file_edits AND NOT hit_resource_limit",
         "Broken command in final steps prevented any file edit: {array_join(late_command_labels, ', ')}. Agent "
         "used a wrong binary name or hardcoded workspace path."),
    Rule("E6", "VERIFICATION", 0.65,
         "produced_patch AND NOT no_file_edits AND has_missing_binary AND NOT catastrophic_edit",
         "Agent produced a patch despite a 'missing binary' environment error. The environment was functional "
         "enough to make the fix; the broken test runner (wrong binary name, e.g. 'python' not found) is a "
         "verification failure, not an environment setup failure."),
    Rule("E7", "VERIFICATION", 0.70, "verified_without_editing",
         "Agent ran the test harness near the end of the run without making any file edit, and tests passed. "
         "This indicates the agent verified the unmodified codebase rather than applying and verifying a fix."),
    Rule("E8", "IMPLEMENTATION_STALL", 0.72,
         "NOT produced_patch AND no_file_edits AND step_count >= 10 AND size(infra_labels) = 0",
         "No file edits in {step_count} steps; no patch produced. Agent explored without committing any change."),
    Rule("E9", "ENVIRONMENT", 0.75, "size(early_env_labels) > 0 AND NOT produced_patch",
         "Environment fingerprint(s) in early steps: {array_join(early_env_labels, ', ')}."),
    Rule("E10", "REASONING", 0.65, "assertion_after_edit AND NOT no_file_edits AND NOT catastrophic_edit",
         "Test assertion failed after file edit on "
         "[{if(size(first_files) > 0, array_join(first_files, ', '), 'unknown')}]. Agent reached and modified the "
         "correct file but the logic in the edit does not satisfy the failing test assertion."),
    Rule("E11", "CONTEXT_RETRIEVAL", 0.60, "narrow_file_search AND NOT hit_resource_limit",
         "Agent opened only {unique_files_opened} distinct file(s) across {step_count} steps without making any "
         "edit. The run likely failed because the agent never located the relevant code to modify."),
]


def _text(template: str) -> str:
    """A rationale as a concat expression."""
    parts = []
    for piece in template.split("{"):
        expression, closed, rest = piece.partition("}") if parts or "}" in piece else ("", "", piece)
        if closed:
            parts.append(f"CAST({expression} AS STRING)")
        parts.append(quoted(rest))
    return "concat(" + ", ".join(p for p in parts if p != "''") + ")"


def _case(subject: str, values: dict[str, str]) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def apply_rules(signals: DataFrame, rationale: bool = False) -> DataFrame:
    """Add ``rule_id``, ``rule_code``, ``rule_confidence`` (null where no rule decides), and with
    ``rationale`` also ``rule_rationale``, which needs a ``first_files`` column."""
    first = "CASE " + " ".join(f"WHEN {r.when} THEN {quoted(r.rule_id)}" for r in RULES) + " END"
    matched = computed_once(signals, rule_id=F.expr(first))
    columns = [
        _case("rule_id", {quoted(r.rule_id): quoted(r.code) for r in RULES}) + " AS rule_code",
        _case("rule_id", {quoted(r.rule_id): f"{r.confidence}D" for r in RULES}) + " AS rule_confidence",
    ]
    if rationale:
        columns.append(_case("rule_id", {quoted(r.rule_id): _text(r.rationale) for r in RULES}) + " AS rule_rationale")
    return matched.selectExpr("*", *columns)

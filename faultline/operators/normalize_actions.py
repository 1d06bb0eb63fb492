"""Action/observation lists to runs: every entry is one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import let
from faultline.functions.text import WHITESPACE, contains_any, lookup, not_blank, nullif_empty, strip
from faultline.operators.normalize_common import (
    NO_STATEMENT, metadata, numbered, observation, shown_at, step, task, to_runs,
)

AGENT = "swe-agent"

# First word of an action and the step type it stands for.
ACTION_WORDS = {
    "bash": "command",
    "execute_bash": "command",
    "python": "command",
    "edit": "file_edit",
    "create": "file_edit",
    "open": "file_read",
    "read_file": "file_read",
    "view": "file_read",
    "scroll_down": "file_read",
    "scroll_up": "file_read",
    "search_file": "command",
    "search_dir": "command",
    "find_file": "command",
    "finish": "finish",
    "submit": "finish",
}
# Marks of a failed command in an observation.
FAILURE_MARKS = ["Error", "error", "Traceback", "FAILED", "exit code: 1"]
SUCCESS_MARK = "exit code: 0"
# Exit states that rule a solution out.
UNRESOLVED_STATES = ["error", "cost", "context"]


def action_type(action: Column) -> Column:
    first_word = F.lower(F.regexp_extract(F.ltrim(action, F.lit(WHITESPACE)), r"(?U)^[^\s\x1c-\x1f]+", 0))
    return lookup(ACTION_WORDS, first_word, "unknown")


def inferred_exit(seen: Column) -> Column:
    """0 on the success mark or a blank text, 1 on a failure mark, else unknown."""
    return F.when(seen.contains(SUCCESS_MARK) | ~not_blank(seen), 0).when(contains_any(seen, FAILURE_MARKS), 1)


_EVENT = "struct<action:string,observation:string>"


def _events(record: Column) -> Column:
    """The action and the observation of every entry as texts, null or empty where they count as false."""
    path = "$.trajectory"

    def checked(texts: Column) -> Column:
        by_type = F.transform(
            F.try_variant_get(record, path, "array<variant>"),
            lambda event: F.struct(
                j.first_truthy_text(j.child(event, "$.action")).alias("action"),
                j.first_truthy_text(j.child(event, "$.observation")).alias("observation"),
            ).cast(_EVENT),
        )
        some_unclear = F.exists(texts, lambda e: F.coalesce(j.unclear(e["action"]) | j.unclear(e["observation"]), F.lit(False)))
        return F.when(some_unclear, by_type).otherwise(texts)

    return F.coalesce(let(F.try_variant_get(record, path, f"array<{_EVENT}>"), checked), F.array().cast(f"array<{_EVENT}>"))


def _step(event: Column) -> Column:
    action, seen = F.coalesce(event["action"], F.lit("")), event["observation"]
    shown = F.when(
        F.length(seen) > 0, observation(seen, inferred_exit(seen))
    )
    return step(action_type(action), action, shown)


def normalize_action_lists(records: DataFrame) -> DataFrame:
    """Runs from records ``record VARIANT`` of the action-list format."""
    r = F.col("record")
    instance_id = shown_at(r, "$.instance_id", "unknown")
    holder = F.when(j.truthy(j.child(r, "$.swe_instance")), j.child(r, "$.swe_instance")).otherwise(j.child(r, "$.instance"))
    state = F.lower(shown_at(r, "$.info.exit_status", ""))
    resolved = (
        (j.truthy(j.child(r, "$.resolved")) | j.truthy(j.child(r, "$.info.resolved")))
        & ~contains_any(state, UNRESOLVED_STATES)
    )
    patch = strip(F.coalesce(j.first_truthy_text(j.child(r, "$.model_patch"), j.child(r, "$.info.submission")), F.lit("")))
    statement = F.coalesce(
        j.first_truthy_text(j.child(holder, "$.problem_statement"), j.child(r, "$.problem_statement")), F.lit(NO_STATEMENT)
    )
    return to_runs(
        records,
        run_id=F.concat(F.lit(f"{AGENT}-"), instance_id), agent=F.lit(AGENT),
        model=j.first_truthy_text(j.child(r, "$.model_name_or_path"), j.child(r, "$.model")),
        task=task(
            instance_id, "swe-bench", shown_at(holder, "$.repo", ""),
            nullif_empty(shown_at(holder, "$.base_commit", "")), statement,
        ),
        steps=numbered(F.transform(_events(r), _step)),
        final_patch=nullif_empty(patch), resolved=resolved,
        metadata=metadata({
            "exit_status": state,
            "api_calls": j.text_of(r, "$.info.model_stats.api_calls"),
            "tokens_sent": j.text_of(r, "$.info.model_stats.tokens_sent"),
            "tokens_received": j.text_of(r, "$.info.model_stats.tokens_received"),
        }),
    )

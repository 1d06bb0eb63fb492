"""Editing sessions, as a summary record or as a chat transcript, to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import let
from faultline.functions.barrier import computed_once
from faultline.functions.text import LINE_BREAK, matches, nullif_empty, strip
from faultline.operators.normalize_common import (
    NO_STATEMENT, metadata, numbered, observation, shown, shown_at, step, task, to_runs,
)
from faultline.schema import STEP

AGENT = "aider"

# Marks in a transcript.
EDIT_MARK = r"(?:Applied edit|Edited|Updated|Modified)\s+`?([^`\n]+)`?"
ERROR_MARK = r"(?:Error|Failed|Traceback|Aider v\S+ is not installed)"


def _no_steps() -> Column:
    return F.array().cast(f"array<{STEP}>")


def transcript_blocks(text: Column) -> Column:
    """Cut a transcript before every line that starts with "> ". Each block holds the action (its first
    line) and what followed; lines before the first action are dropped."""
    lines = F.concat(F.lit("\n"), F.regexp_replace(text, LINE_BREAK, "\n"))

    def parts(blocks: Column) -> Column:
        return F.transform(
            F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
            lambda b, i: F.struct(
                strip(F.substring_index(b, "\n", 1)).alias("action"),
                strip(F.when(b.contains("\n"), F.substring(b, F.instr(b, "\n") + 1, F.length(b))).otherwise("")).alias("seen"),
                (i == F.size(blocks) - 2).alias("is_last"),
            ),
        )

    return let(F.split(lines, "\n> "), parts)


def block_step(block: Column) -> Column:
    action, seen, last = block["action"], block["seen"], block["is_last"]
    kind = F.when(
        last, F.when(F.lower(action).contains("commit"), "finish").otherwise("command")
    ).otherwise(F.when(matches(seen, EDIT_MARK), "file_edit").otherwise("command"))
    code = F.when(~last & matches(seen, ERROR_MARK), 1).otherwise(0)
    shown_text = F.when(F.length(seen) > 0, observation(seen, code))
    return step(kind, action, shown_text)


def transcript_steps(blocks: Column) -> Column:
    """Steps of the blocks; a block with an empty action is no step."""
    return numbered(F.transform(F.filter(blocks, lambda b: F.length(b["action"]) > 0), block_step))


def summary_steps(record: Column) -> Column:
    """One edit per file, then the error if any, then the last commit if any."""
    files = F.transform(
        j.array_at(record, "$.files_edited"),
        lambda f: step(
            F.lit("file_edit"), F.concat(F.lit("edit "), shown(f)),
            observation(F.concat(F.lit("Applied edit to "), shown(f)), F.lit(0)),
        ),
    )
    error = j.child(record, "$.error")
    crash = F.when(
        j.truthy(error), F.array(step(F.lit("command"), F.lit("(aider internal)"), observation(shown(error), F.lit(1))))
    ).otherwise(_no_steps())
    commits = j.array_at(record, "$.commits")
    message = shown_at(F.try_element_at(commits, F.lit(-1)), "$.message", "")
    commit = F.when(
        F.size(commits) > 0,
        F.array(step(F.lit("finish"), F.concat(F.lit("git commit: "), message), observation(F.lit("committed"), F.lit(0)))),
    ).otherwise(_no_steps())
    return numbered(F.concat(files, crash, commit))


def normalize_sessions(records: DataFrame) -> DataFrame:
    """Runs from records ``record VARIANT`` of the session format. A record whose exit status is not a
    number is dropped."""
    r = F.col("record")
    error, status = j.child(r, "$.error"), j.child(r, "$.exit_status")
    code = F.when(status.isNull(), j.truthy(error).cast("int")).otherwise(j.integer_of(status))
    commits = j.array_at(r, "$.commits")
    history = j.child(r, "$.chat_history")
    checked = computed_once(records, _exit=code).filter(F.col("_exit").isNotNull())
    rows = computed_once(checked, _blocks=let(history, lambda h: F.when(j.truthy(h), transcript_blocks(shown(h)))))
    instance_id = F.when(j.has_key(r, "instance_id"), shown(j.child(r, "$.instance_id"))).otherwise(
        shown_at(r, "$.task_id", "aider-run")
    )
    solved = (F.col("_exit") == 0) & ~j.truthy(error) & j.truthy(j.child(r, "$.files_edited"))
    return to_runs(
        rows,
        run_id=F.concat(F.lit(f"{AGENT}-"), instance_id), agent=F.lit(AGENT),
        model=nullif_empty(shown_at(r, "$.model", "")),
        task=task(
            instance_id, "aider", shown_at(r, "$.repo", ""), F.lit(None).cast("string"),
            shown_at(r, "$.problem_statement", NO_STATEMENT),
        ),
        steps=F.when(F.col("_blocks").isNotNull(), transcript_steps(F.col("_blocks"))).otherwise(summary_steps(r)),
        final_patch=F.coalesce(
            j.first_truthy_text(j.child(r, "$.patch")), j.text_of(F.try_element_at(commits, F.lit(-1)), "$.diff")
        ),
        resolved=solved,
        metadata=metadata({
            "cost": j.text_of(r, "$.cost"), "tokens": j.text_of(r, "$.tokens"),
            "files_edited": j.text_of(r, "$.files_edited"), "edit_format": j.text_of(r, "$.edit_format"),
            "error": j.text_of(error), "exit_status": F.col("_exit").cast("string"),
        }),
    )

"""Chats with tool calls to runs: one step per call, its answer joined by call id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import group_starts, groups, let
from faultline.functions.text import contains_any, lookup, nullif_empty, strip
from faultline.operators.normalize_common import (
    NO_STATEMENT, metadata, numbered, observation, shown, shown_at, step, task, to_runs,
)

AGENT = "autocoderover"

# Tool names by the step type they stand for.
TOOLS = {
    "search_method_in_file": "file_read",
    "search_class_in_file": "file_read",
    "search_code_in_file": "file_read",
    "get_code_around_issue": "file_read",
    "get_relevant_code": "file_read",
    "view_file": "file_read",
    "open_file": "file_read",
    "search_method": "command",
    "search_class": "command",
    "search_code": "command",
    "search_method_in_class": "command",
    "run_test": "command",
    "execute_command": "command",
    "write_patch": "file_edit",
    "apply_patch": "file_edit",
    "edit_file": "file_edit",
    "create_file": "file_edit",
    "modify_code": "file_edit",
    "finish": "finish",
    "submit": "finish",
    "done": "finish",
}
# Marks of a failed call in its answer (lower case).
FAILURE_MARKS = ["error", "traceback", "not found", "failed"]

def rendered_arguments(call: Column) -> Column:
    """The arguments as JSON, cut to 300 characters; text that is no JSON goes under ``raw``."""

    def rendered(given: Column) -> Column:
        text = given["text"]
        valid = ~given["quoted"] | (j.may_be_json(text) & j.parse_strict(text).isNotNull())
        return F.when(valid, F.coalesce(text, F.lit("null"))).otherwise(F.to_json(F.struct(text.alias("raw"))))

    def read(raw: Column) -> Column:
        text = F.when(raw.isNull(), F.lit("{}")).otherwise(j.text_of(raw))
        return let(F.struct(text.alias("text"), j.is_string(raw).alias("quoted")), rendered)

    return j.spaced_json(let(j.child(call, "$.function.arguments"), read))


def inferred_exit(answer: Column) -> Column:
    return F.when(contains_any(F.lower(answer), FAILURE_MARKS), 1).otherwise(0)


def _read(message: Column) -> Column:
    """A message with its role and calls. Only a string has one of the texts a role is compared with."""
    return F.struct(
        message.alias("message"), j.text_of(message, "$.role").alias("role"), j.array_at(message, "$.tool_calls").alias("calls")
    )


def _entries(read: Column, at: Column) -> Column:
    """Calls, answers and plain texts of a message (``_read``) as sortable entries: ``id, is_call, pos, sub``."""
    message, role, calls = read["message"], read["role"], read["calls"]
    none = F.lit(None).cast("string")

    def entry(call_id, is_call, sub, name, content) -> Column:
        return F.struct(
            call_id.alias("id"), F.lit(is_call).alias("is_call"), at.alias("pos"), sub.alias("sub"),
            name.alias("name"), content.alias("content"),
        )

    answer = F.array(
        entry(shown_at(message, "$.tool_call_id", ""), 0, F.lit(0), none, shown_at(message, "$.content", ""))
    )
    called = F.transform(
        calls,
        lambda c, i: entry(
            shown_at(c, "$.id", ""), 1, i, shown_at(c, "$.function.name", "unknown"), rendered_arguments(c)
        ),
    )
    said = F.array(entry(F.lit(""), 2, F.lit(0), none, shown(j.child(message, "$.content"))))
    empty = F.filter(answer, lambda _: F.lit(False))
    return (
        F.when(role == "tool", answer)
        .when((role == "assistant") & (F.size(calls) > 0), called)
        .when((role == "assistant") & j.truthy_at(message, "$.content"), said)
        .otherwise(empty)
    )


def chat_steps(records: DataFrame, messages: Column, result: str = "steps") -> DataFrame:
    """Join the calls of each chat with their answers (the last answer per id, wherever it stands).

    Sorting by id brings calls and answers together inside the row, so the join is n log n in the
    length of the chat and needs no shuffle.
    """
    entries = F.flatten(F.transform(F.transform(messages, _read), _entries))
    split = records.withColumn("_entries", F.coalesce(entries, F.array().cast("array<struct<id:string,is_call:int,pos:int,sub:int,name:string,content:string>>")))
    grouped = let(
        F.array_sort(F.filter("_entries", lambda e: e["is_call"] < 2)),
        lambda ordered: let(
            group_starts(ordered, lambda e: e["id"]), lambda starts: groups(ordered, starts)
        ),
    )
    answered = split.withColumn(
        "_groups",
        F.transform(
            grouped,
            lambda g: F.struct(
                F.filter(g, lambda e: e["is_call"] == 1).alias("calls"),
                F.get(F.reverse(F.filter(g, lambda e: e["is_call"] == 0)), 0)["content"].alias("answer"),
            ),
        ),
    )

    def placed(e: Column, made: Column) -> Column:
        return F.struct(e["pos"].alias("pos"), e["sub"].alias("sub"), made.alias("step"))

    def call_step(e: Column, answer: Column) -> Column:
        seen = F.when(
            F.length(answer) > 0, observation(answer, inferred_exit(answer))
        )
        content = F.concat(e["name"], F.lit("("), e["content"], F.lit(")"))
        return placed(e, step(lookup(TOOLS, F.lower(e["name"]), "unknown"), content, seen))

    calls = F.flatten(F.transform("_groups", lambda g: F.transform(g["calls"], lambda e: call_step(e, g["answer"]))))
    texts = F.transform(
        F.filter("_entries", lambda e: e["is_call"] == 2),
        lambda e: placed(e, step(F.lit("unknown"), e["content"], F.lit(None))),
    )
    ordered = F.array_sort(
        F.concat(calls, texts),
        lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(a["sub"] - b["sub"]),
    )
    return answered.withColumn(result, numbered(ordered, lambda x: x["step"])).drop(
        "_entries", "_groups"
    )


def normalize_chats(records: DataFrame) -> DataFrame:
    """Runs from records ``record VARIANT`` of the chat format."""
    r = F.col("record")
    rows = chat_steps(records, j.array_at(r, "$.trajectory"))
    instance_id = shown_at(r, "$.instance_id", "unknown")
    return to_runs(
        rows,
        run_id=F.concat(F.lit("acr-"), instance_id), agent=F.lit(AGENT),
        model=nullif_empty(shown_at(r, "$.model", "")),
        task=task(
            instance_id, "swe-bench", shown_at(r, "$.repo", ""), nullif_empty(shown_at(r, "$.base_commit", "")),
            F.coalesce(j.first_truthy_text(j.child(r, "$.problem_statement")), F.lit(NO_STATEMENT)),
        ),
        steps=F.col("steps"), final_patch=nullif_empty(strip(shown_at(r, "$.patch", ""))),
        resolved=j.truthy(j.child(r, "$.resolved")),
        metadata=metadata({
            "test_output": shown_at(r, "$.test_output", ""),
            "acr_version": j.text_of(r, "$.acr_version"),
        }),
    )

"""Shared pieces of the log normalizers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import let
from faultline.schema import OBSERVATION, RUN_DDL, STEP, struct

NO_STATEMENT = "No problem statement provided."


def observation(content: Column, exit_code: Column, extra: Column | None = None) -> Column:
    return F.struct(
        content.alias("content"), exit_code.cast("int").alias("exit_code"), F.lit(False).alias("truncated"),
        (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"),
    ).cast(OBSERVATION)


def step(action_type: Column, content: Column, seen: Column, metadata: Column | None = None) -> Column:
    """A step without its number; ``seen`` is an observation or null."""
    return F.struct(
        F.lit(0).alias("index"), action_type.alias("action_type"), content.alias("content"),
        seen.alias("observation"), F.lit(None).cast("timestamp").alias("timestamp"),
        (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
    ).cast(STEP)


def numbered(items: Column, step_of: Callable[[Column], Column] = lambda item: item) -> Column:
    """Number the steps by their place in the array, whose items are steps or hold one each."""

    def placed(item: Column, i: Column) -> Column:
        s = step_of(item)
        return F.struct(
            i.alias("index"), s["action_type"].alias("action_type"), s["content"].alias("content"),
            s["observation"].alias("observation"), s["timestamp"].alias("timestamp"), s["metadata"].alias("metadata"),
        )

    return F.transform(items, placed).cast(f"array<{STEP}>")


def shown(value: Column) -> Column:
    """Text of a present value the way the logs' own tools print it: ``None``, ``True``, ``False``."""
    capital = {"true": "True", "false": "False"}

    def printed(text: Column) -> Column:
        named = F.when(text == "true", capital["true"]).when(text == "false", capital["false"])
        return F.coalesce(
            F.when(text.isin(*capital), F.when(j.kind(value) == "BOOLEAN", named)), text, F.when(value.isNotNull(), "None"))

    return let(j.text_of(value), printed)


def shown_at(record: Column, path: str, default: str) -> Column:
    """Printed member, or ``default`` where the key is absent."""
    printed = F.coalesce(let(j.child(record, path), shown), F.lit(default))
    # Most texts are printed as they are, whatever the member's type.
    return let(
        j.text_of(record, path), lambda text: F.when(text.isNull() | text.isin("true", "false"), printed).otherwise(text)
    )


def task(task_id: Column, source: str, repo: Column, base_commit: Column, statement: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        task_id.alias("task_id"), F.lit(source).alias("source"), repo.alias("repo"),
        base_commit.alias("base_commit"), statement.alias("problem_statement"), none.alias("gold_patch"),
        F.array().cast("array<string>").alias("test_directives"),
    )


def metadata(record_values: dict[str, Column]) -> Column:
    """A text map; values may be null."""
    return F.create_map(*[x for k, v in record_values.items() for x in (F.lit(k), v.cast("string"))])


def to_runs(rows: DataFrame, **columns: Column) -> DataFrame:
    """Project onto the run schema; columns not given are null."""
    schema = struct(RUN_DDL)
    return rows.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )

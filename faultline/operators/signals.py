"""Deterministic signals: one wide row per run.

Two forms give the same columns:

* ``signals_from_steps`` folds a steps table. Two aggregations, both combined before their shuffle:
  first per (run, command or opened file), then per run. No step rows of a run are ever gathered.
* ``signals_from_runs`` reads nested runs row by row, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import stepflags
from faultline.functions.arrays import group_starts, let
from faultline.functions.barrier import computed_once
from faultline.functions.sqltext import quoted
from faultline.operators.steps import catastrophic_edit, produced_patch
from faultline.taxonomy import FINGERPRINTS, LABELS

REPEATED = 3  # identical commands that count as thrashing
NARROW_STEPS, NARROW_FILES = 20, 3

_ALL = range(len(FINGERPRINTS))
_MISSING_BINARY, _WRONG_PATH = LABELS.index("missing binary"), LABELS.index("wrong path")
_BROKEN_COMMAND = [_MISSING_BINARY, _WRONG_PATH]


def _ids(code: str) -> list[int]:
    return [i for i in _ALL if FINGERPRINTS[i][1] == code]


_ENVIRONMENT = _ids("ENVIRONMENT")


def _labels(present: dict[int, str]) -> str:
    """Sorted, distinct labels of the fingerprints whose condition holds."""
    ordered = sorted(present, key=lambda i: LABELS[i])
    return "array_compact(array(" + ", ".join(f"CASE WHEN {present[i]} THEN {quoted(LABELS[i])} END" for i in ordered) + "))"


def step_facts(steps: DataFrame, *keep: str) -> DataFrame:
    """The narrow per-step facts the fold needs, and the ``keep`` columns: all regexes run here, before any
    shuffle, and the long texts end here."""
    flagged = steps.selectExpr(
        *keep, "run_id", "index", "action_type", "exit_code", "has_obs", "coalesce(obs_content, '') AS _obs",
        f"{stepflags.failed(*stepflags.STEP_COLUMNS)} AS failed",
        f"{stepflags.runs_tests('action_type', 'content')} AS is_test",
        f"{stepflags.runs_test_harness('action_type', 'content')} AS is_harness",
        f"{stepflags.command_text('action_type', 'content')} AS _command",
        f"{stepflags.opened_path('action_type', 'content')} AS _opened",
    )
    return flagged.selectExpr(
        *keep, "run_id", "index", "failed", "is_test", "action_type = 'file_edit' AS is_edit",
        "action_type = 'finish' AS is_finish",
        # A long command is grouped by its digest, a short one by itself; both exact.
        """CASE WHEN length(_command) <= 64 THEN concat('c', _command)
                WHEN _command IS NOT NULL THEN concat('C', sha2(_command, 256))
                WHEN _opened IS NOT NULL THEN concat('r', _opened) END AS item""",
        f"{stepflags.fingerprint('_obs', 'failed')} AS fp",
        f"{stepflags.assertion_failure('failed', '_obs')} AS is_assertion",
        f"{stepflags.test_verdict('is_test', '_obs')} AS verdict",
        f"{stepflags.harness_ok('is_harness', 'has_obs', 'exit_code')} AS harness_ok",
    )


_SUMS = {
    "step_count": "count(*)",
    "n_failed_steps": "count_if(failed)",
    "n_edits": "count_if(is_edit)",
    "n_tests": "count_if(is_test)",
    "n_finish": "count_if(is_finish)",
    **{f"fp{i}": f"count_if(fp = {i})" for i in _ALL},
}
# The latest value of a fact is the maximum of ``index * 2 + flag``.
_MAXIMA = {
    "last_edit": "max(CASE WHEN is_edit THEN index END)",
    "last_assertion": "max(CASE WHEN is_assertion THEN index END)",
    "last_verdict": "max(index * 2 + verdict)",
    "last_harness": "max(index * 2 + harness_ok)",
    **{f"late{i}": f"max(CASE WHEN fp = {i} THEN index END)" for i in _BROKEN_COMMAND},
}
_MINIMA = {
    "first_edit": "min(CASE WHEN is_edit THEN index END)",
    **{f"early{i}": f"min(CASE WHEN fp = {i} THEN index END)" for i in _ENVIRONMENT},
}


#: All folds; each merges with itself in any order.
FOLDED = (_SUMS, _MAXIMA, _MINIMA)


def fold_steps(steps: DataFrame) -> DataFrame:
    """Per-run sums, first and last positions over a steps table. All buffers are plain numbers, so both
    aggregations hash and combine before they shuffle."""
    per_item = step_facts(steps).groupBy("run_id", "item").agg(
        *[F.expr(f"{e} AS {n}") for part in FOLDED for n, e in part.items()]
    )
    return per_item.groupBy("run_id").agg(
        *[F.expr(f"sum({n}) AS {n}") for n in _SUMS],
        *[F.expr(f"max({n}) AS {n}") for n in _MAXIMA],
        *[F.expr(f"min({n}) AS {n}") for n in _MINIMA],
        F.expr("count_if(startswith(item, 'r')) AS unique_files_opened"),
        F.expr(f"count_if(lower(substring(item, 1, 1)) = 'c' AND step_count >= {REPEATED}) AS n_repeated_commands"),
    )


def signals_from_steps(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Signals from a steps table and the runs' own columns
    (``run_id, task_id, agent, model, final_patch, test_passed, error``, one row per run)."""
    return derive(own_facts(runs).join(fold_steps(steps), "run_id", "left"))


def own_facts(runs: DataFrame) -> DataFrame:
    """What the signals take from a run's own columns."""
    return runs.select(
        "run_id", "task_id", "agent", "model", "test_passed",
        produced_patch(F.col("final_patch")).alias("produced_patch"),
        catastrophic_edit(F.col("final_patch")).alias("catastrophic_edit"),
        F.expr("coalesce(length(error) > 0, false) AS framework_error"),
    )


def _total(code: str) -> str:
    return " + ".join(f"fp{i}" for i in _ids(code))


def derive(folded: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Turn the folded columns into the signals the rules read; ``extra`` columns pass through."""
    counts = [*_SUMS, "unique_files_opened", "n_repeated_commands"]
    kept = [c for c in folded.columns if c not in counts]
    filled = folded.selectExpr(
        *[f"`{c}`" for c in kept], *[f"coalesce({c}, 0) AS {c}" for c in counts],
        "coalesce(test_passed, last_verdict % 2 = 1) AS tests_passed",
    )
    found = {i: f"fp{i} > 0" for i in _ALL}
    return filled.selectExpr(
        "run_id", "task_id", "agent", "model", "step_count", "produced_patch",
        "n_edits = 0 AS no_file_edits", "n_tests > 0 AS ran_tests", "tests_passed",
        "n_finish > 0 AS finished_explicitly",
        "n_finish > 0 AND n_tests = 0 AS finished_without_testing",
        "n_finish > 0 AND coalesce(NOT tests_passed, false) AS finished_on_red",
        f"{_total('RESOURCE_LIMIT')} > 0 AS hit_resource_limit",
        "framework_error", "catastrophic_edit",
        """n_edits = 0 AND coalesce(last_harness % 2 = 1, false)
           AND coalesce(last_harness DIV 2 >= step_count - greatest(1, step_count DIV 5), false)
           AS verified_without_editing""",
        "unique_files_opened",
        "coalesce(last_assertion >= first_edit, false) AS assertion_after_edit",
        f"step_count >= {NARROW_STEPS} AND n_edits = 0 AND unique_files_opened < {NARROW_FILES} AS narrow_file_search",
        "coalesce(last_edit, -1) AS last_edit_step_index",
        "n_failed_steps", "n_repeated_commands",
        " + ".join(f"fp{i}" for i in _ALL) + " AS n_error_fingerprints",
        f"{_total('INFRA_ERROR')} AS n_infra_fps",
        f"{_total('ENVIRONMENT')} AS n_env_fps",
        f"{_total('TOOL_USE')} AS n_tool_fps",
        _labels({i: found[i] for i in _ids("INFRA_ERROR")}) + " AS infra_labels",
        _labels({i: found[i] for i in _ids("RESOURCE_LIMIT")}) + " AS resource_labels",
        _labels({i: found[i] for i in _ids("TOOL_USE")}) + " AS tool_labels",
        _labels({i: f"early{i} < greatest(3, step_count DIV 4)" for i in _ENVIRONMENT}) + " AS early_env_labels",
        _labels({i: f"late{i} >= step_count - greatest(2, step_count DIV 10)" for i in _BROKEN_COMMAND})
        + " AS late_command_labels",
        f"{found[_MISSING_BINARY]} AS has_missing_binary",
        *extra,
    )


# ---------------------------------------------------------------------------------------------
# Nested runs

_LISTS = ("failed_step_indices", "edited_files", "error_fingerprints", "repeated_commands")


def signals_from_runs(runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of nested runs, row by row and without a shuffle. Adds the ordered lists
    (``edited_files``, ``failed_step_indices``, ``error_fingerprints``, ``repeated_commands``) which a
    nested run bounds by its own row, and passes the ``keep`` columns through."""
    empty = F.coalesce("steps", F.array().cast(runs.schema["steps"].dataType))
    facts = runs.withColumn("steps", empty).withColumn("_facts", F.expr(_nested_facts()))

    def where(condition: str) -> str:
        return f"filter(_facts, s -> {condition})"

    def pick(value: str, condition: str) -> str:
        return f"transform({where(condition)}, s -> {value})"

    def last(value: str, condition: str) -> str:
        return f"try_element_at({pick(value, condition)}, -1)"

    commands = F.expr(pick("struct(s.command AS command, s.pos AS pos)", "s.command IS NOT NULL"))
    found = f"named_struct('step', s.index, 'code', {stepflags.code_of('s.fp')}, 'label', {stepflags.label_of('s.fp')})"
    own = facts.select(
        *dict.fromkeys(["run_id", "agent", "model", *keep]),
        F.expr("task.task_id AS task_id"),
        F.expr("test_result.passed AS test_passed"),
        produced_patch(F.col("final_patch")).alias("produced_patch"),
        catastrophic_edit(F.col("final_patch")).alias("catastrophic_edit"),
        F.expr("coalesce(length(error) > 0, false) AS framework_error"),
        F.expr("size(steps) AS step_count"),
        F.expr(pick("s.index", "s.failed") + " AS failed_step_indices"),
        F.expr(pick("s.edited", "s.edited IS NOT NULL") + " AS edited_files"),
        F.expr(f"size(array_distinct({pick('s.opened', 's.opened IS NOT NULL')})) AS unique_files_opened"),
        F.expr(pick(found, "s.fp IS NOT NULL") + " AS error_fingerprints"),
        _repeats(commands).alias("repeated_commands"),
        F.expr(f"size({where('s.is_edit')}) AS n_edits"),
        F.expr(f"array_min({pick('s.pos', 's.is_edit')}) AS first_edit"),
        F.expr(last("s.index", "s.is_edit") + " AS last_edit"),
        F.expr(last("s.pos", "s.is_assertion") + " AS last_assertion"),
        F.expr(f"size({where('s.is_test')}) AS n_tests"),
        F.expr(last("s.verdict", "s.verdict IS NOT NULL") + " AS last_verdict"),
        F.expr(last("s.index * 2 + s.harness_ok", "s.harness_ok IS NOT NULL") + " AS last_harness"),
        F.expr(f"size({where('s.is_finish')}) AS n_finish"),
        *[F.expr(f"size({where(f's.fp = {i}')}) AS fp{i}") for i in _ALL],
        *[F.expr(f"array_min({pick('s.index', f's.fp = {i}')}) AS early{i}") for i in _ENVIRONMENT],
        *[F.expr(f"array_max({pick('s.index', f's.fp = {i}')}) AS late{i}") for i in _BROKEN_COMMAND],
    ).selectExpr(
        "*", "size(failed_step_indices) AS n_failed_steps", "size(repeated_commands) AS n_repeated_commands"
    )
    return derive(own, (*keep, *_LISTS))


def _nested_facts() -> str:
    """The facts of every nested step, as one expression over ``steps``."""
    action, content, seen = "s.action_type", "coalesce(s.content, '')", "coalesce(s.observation.content, '')"
    has_obs, code = "s.observation IS NOT NULL", "s.observation.exit_code"
    failed = stepflags.failed(action, has_obs, code)
    fields = {
        "pos": "pos",
        "index": "s.index",
        "failed": failed,
        "is_edit": f"{action} = 'file_edit'",
        "is_finish": f"{action} = 'finish'",
        "is_test": stepflags.runs_tests(action, content),
        "command": stepflags.command_text(action, content),
        "opened": stepflags.opened_path(action, content),
        "edited": stepflags.edited_path(action, content),
        "fp": stepflags.fingerprint(seen, failed),
        "is_assertion": stepflags.assertion_failure(failed, seen),
        "verdict": stepflags.test_verdict(stepflags.runs_tests(action, content), seen),
        "harness_ok": stepflags.harness_ok(stepflags.runs_test_harness(action, content), has_obs, code),
    }
    return "transform(steps, (s, pos) -> named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + "))"


def _repeats(commands: Column) -> Column:
    """(command, count) of commands seen at least ``REPEATED`` times, in first-seen order.

    Sorting brings equal commands together; the distance between group starts is the count."""

    def counted(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, j: F.struct(
                F.get(ordered, start)["pos"].alias("pos"),
                F.get(ordered, start)["command"].alias("command"),
                (F.get(starts, j + 1) - start).alias("count"),
            ),
        )

    groups = let(
        F.array_sort(commands),
        lambda ordered: let(
            group_starts(ordered, lambda c: c["command"]), lambda starts: counted(ordered, starts)
        ),
    )
    kept = F.array_sort(F.filter(groups, lambda g: g["count"] >= REPEATED))
    return F.transform(kept, lambda g: F.struct(g["command"].alias("command"), g["count"].alias("count")))


# ---------------------------------------------------------------------------------------------
# Long forms of the list signals


def fingerprints(steps: DataFrame) -> DataFrame:
    """One row per fingerprinted step: ``run_id, step_index, code, label``."""
    rejected = steps.filter(stepflags.failed(*stepflags.STEP_COLUMNS)).selectExpr(
        "run_id", "index AS step_index", "obs_content"
    )
    found = computed_once(rejected, _fp=F.expr(stepflags.fingerprint("obs_content"))).filter("_fp IS NOT NULL")
    return found.selectExpr(
        "run_id", "step_index", f"{stepflags.code_of('_fp')} AS code", f"{stepflags.label_of('_fp')} AS label"
    )


def edited_files(steps: DataFrame) -> DataFrame:
    """One row per edit whose content names a file."""
    edits = steps.filter("action_type = 'file_edit'").selectExpr("run_id", "index AS step_index", "content")
    paths = computed_once(edits, path=F.expr(stepflags.touched_path("content"))).drop("content")
    return paths.filter("path IS NOT NULL")


def repeated_commands(steps: DataFrame) -> DataFrame:
    """Commands issued at least three times in a run, with their first position."""
    commands = steps.filter("action_type = 'command'").selectExpr(
        "run_id", "index", f"{stepflags.command_text('action_type', 'content')} AS command"
    )
    counted = commands.groupBy("run_id", "command").agg(
        F.count("*").alias("count"), F.min("index").alias("first_index")
    )
    return counted.filter(F.col("count") >= REPEATED)


def opened_files(steps: DataFrame) -> DataFrame:
    """How many distinct files each run opened, and how many open steps named one."""
    reads = steps.filter("action_type = 'file_read'").select("run_id", "content")
    opened = computed_once(reads, path=F.expr(stepflags.touched_path("content"))).filter("path IS NOT NULL")
    per_file = opened.groupBy("run_id", "path").agg(F.count("*").alias("opens"))
    return per_file.groupBy("run_id").agg(
        F.count("*").alias("unique_files_opened"), F.sum("opens").alias("n_opens")
    )


def first_fingerprints(steps: DataFrame, per_code: int = 3) -> DataFrame:
    """Per run and code, the first fingerprints as an ordered array of at most ``per_code``. The rank
    filter keeps as many rows per group and task before the shuffle."""
    order = Window.partitionBy("run_id", "code").orderBy("step_index")
    head = fingerprints(steps).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_code)
    return head.groupBy("run_id", "code").agg(F.expr("array_sort(collect_list(struct(step_index, label))) AS hits"))


def first_edited_files(steps: DataFrame, n: int = 3) -> DataFrame:
    """Per run, the paths of the first ``n`` edits that name a file."""
    order = Window.partitionBy("run_id").orderBy("step_index")
    head = edited_files(steps).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return head.groupBy("run_id").agg(
        F.expr("transform(array_sort(collect_list(struct(step_index, path))), x -> x.path) AS first_files")
    )

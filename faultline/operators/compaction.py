"""Evidence-dense text of a run, the input of a model.

For a steps table the text comes in parts, keyed ``run_id, part`` and numbered from 0: joined in order with
nothing between them, the parts are the whole text, equal to that of the nested run. For nested runs it is
one string per row.

The whole text has five lists of any length (failed steps, repeated commands, fingerprints, edited files and
the salient steps) between fragments of bounded length. Every list's items are numbered by prefix sums over
the counts of their chunks; the same sums, over the lists in their order, give each item its part, so no run
is gathered and a part holds at most ``PART_STEPS`` items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import stepflags
from faultline.functions.barrier import computed_once
from faultline.functions.sequence import join_by_chunk, with_previous
from faultline.functions.text import shorten
from faultline.operators.signals import repeated_commands, signals_from_runs, signals_from_steps
from faultline.session import cut_lineage
from faultline.taxonomy import CATEGORIES

KEEP_HEAD, KEEP_TAIL = 2, 6
STEP_CHARS, STATEMENT_CHARS, PATCH_CHARS, LOG_CHARS = 600, 1500, 2000, 800
PART_STEPS = 256
CHUNK_ROWS = 16_384

# The lines around the parts of the text.
TASK_HEAD = "=== TASK ==="
SIGNALS_HEAD = "\n=== DETERMINISTIC SIGNALS ==="
STEPS_HEAD = "\n=== TRAJECTORY (salient steps) ==="
PATCH_HEAD = "\n=== FINAL PATCH ==="
TEST_HEAD = "\n=== TEST RESULT ==="

#: The lists of the signal record, in the order in which they stand in it.
LISTS = ("failed_step_indices", "repeated_commands", "error_fingerprints", "edited_files")
STEPS_SECTION = len(LISTS)

_EXPORTED = (
    "produced_patch", "no_file_edits", "ran_tests", "tests_passed", "finished_explicitly",
    "finished_without_testing", "finished_on_red", "failed_step_indices", "repeated_commands",
    "error_fingerprints", "hit_resource_limit", "framework_error", "catastrophic_edit",
    "verified_without_editing", "step_count", "unique_files_opened", "edited_files",
    "assertion_after_edit", "narrow_file_search",
)


def signals_json(columns: list[str]) -> Column:
    """The exported signals among ``columns`` as a JSON record, nulls included."""
    shown = [F.col(c) for c in _EXPORTED if c in columns]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def step_text(index: Column, action: Column, content: Column, seen: Column, has_obs: Column, exit_code: Column) -> Column:
    """``[i] type: content`` and the observation, long texts cut (observations in the middle)."""
    half = STEP_CHARS // 2
    body = F.coalesce(seen, F.lit(""))
    body = F.when(
        F.length(body) > STEP_CHARS,
        F.concat(F.substring(body, 1, half), F.lit("\n...[truncated]...\n"), F.right(body, F.lit(half))),
    ).otherwise(body)
    code = F.when(exit_code.isNotNull(), F.concat(F.lit("exit="), exit_code.cast("string"), F.lit(" | "))).otherwise("")
    observed = F.when(has_obs, F.concat(F.lit("\n    -> "), code, body)).otherwise("")
    return F.concat(
        F.lit("["), index.cast("string"), F.lit("] "), action, F.lit(": "),
        shorten(F.coalesce(content, F.lit("")), STEP_CHARS), observed,
    )


def _gap(index: Column, previous: Column) -> Column:
    skipped = index - previous - 1
    return F.when(skipped > 0, F.concat(F.lit("... ["), skipped.cast("string"), F.lit(" step(s) omitted] ...\n"))).otherwise("")


def is_salient(failed: str, action: str, index: str, n: str) -> str:
    """Failed (which covers fingerprinted) steps, edits, the first two and the last six."""
    return f"({failed} OR {action} = 'file_edit' OR {index} >= {n} - {KEEP_TAIL} OR {index} < {KEEP_HEAD})"


def salient_steps(steps: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The kept rows of a steps table, with ``previous`` (the kept index before) and ``skipped``."""
    sizes = steps.groupBy("run_id").agg(F.count("*").alias("n"))
    spread = join_by_chunk(steps, sizes, "run_id", "index", "n", chunk_rows)
    kept = spread.filter(is_salient(stepflags.failed(*stepflags.STEP_COLUMNS), "action_type", "index", "n"))
    linked = with_previous(kept, "run_id", "chunk", "index", F.col("index"), "previous")
    return linked.withColumn("skipped", F.coalesce(F.col("index") - F.col("previous") - 1, F.lit(0))).drop("chunk")


def _header(task_id: Column, repo: Column, statement: Column, signals: Column | None = None, steps: bool = True) -> Column:
    record = [] if signals is None else [F.lit(SIGNALS_HEAD), signals]
    end = [F.lit(STEPS_HEAD)] if steps else []
    return F.concat_ws(
        "\n", F.lit(TASK_HEAD), F.concat(F.lit("task_id: "), task_id),
        F.when(F.length(repo) > 0, F.concat(F.lit("repo: "), repo)), F.lit("problem_statement:"),
        shorten(F.coalesce(statement, F.lit("")), STATEMENT_CHARS), *record, *end,
    )


def _patch_lines(patch: Column) -> Column:
    body = F.when(F.length(patch) > 0, shorten(patch, PATCH_CHARS)).otherwise("(none produced)")
    return F.concat(F.lit(PATCH_HEAD + "\n"), body)


def _printed(value: Column) -> Column:
    return F.coalesce(F.initcap(value.cast("string")), F.lit("None"))


def _test_lines(passed: Column, total: Column, good: Column, bad: Column, log: Column) -> Column:
    """The test result's lines, null without one."""
    counts = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("None")))
              for name, value in (("total", total), ("passed_tests", good), ("failed_tests", bad))]
    return F.when(passed.isNotNull(), F.concat_ws(
        "\n", F.lit(TEST_HEAD), F.concat_ws(" ", F.concat(F.lit("passed="), _printed(passed)), *counts),
        F.when(F.length(log) > 0, F.substring(log, 1, LOG_CHARS))))


def _line() -> Column:
    """A salient step's text, with the gap before it."""
    return F.concat(
        _gap(F.col("index"), F.col("previous")),
        step_text(*(F.col(c) for c in ("index", "action_type", "content", "obs_content", "has_obs", "exit_code"))),
    )


def _step_parts(steps: DataFrame) -> DataFrame:
    """``run_id, part, text`` of the salient steps; parts count from 1."""
    lines = salient_steps(steps).select("run_id", "index", _line().alias("line"))
    return lines.groupBy("run_id", (F.floor(F.col("index") / PART_STEPS) + 1).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def run_words(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, text``, several rows per run: its task, salient steps and patch, as a compacted text shows them.

    The derived signals and the test result are left out, so what matches here stands in the run itself.
    """
    framing = F.concat_ws(
        "\n", _header(F.col("task_id"), F.col("repo"), F.col("problem_statement")), _patch_lines(F.col("final_patch"))
    )
    return _step_parts(steps).select("run_id", "text").unionByName(runs.select("run_id", framing.alias("text")))


def _json_string(text: Column) -> Column:
    """The text as a JSON string: a one-field record without its frame."""
    record = F.to_json(F.struct(text.alias("t")))
    return F.substring(record, F.lit(6), F.length(record) - 6)


def _list_items(steps: DataFrame) -> DataFrame:
    """``run_id, section, position, item``: what the lists of a whole text hold, without separators.

    Three of the lists come from one pass over the steps.
    """
    rejected, name = stepflags.failed(*stepflags.STEP_COLUMNS), "nullif(_fp, -1)"
    facts = computed_once(
        steps.select("run_id", "index", "action_type", "content", "obs_content", "has_obs", "exit_code"),
        _fp=F.expr(f"coalesce({stepflags.fingerprint('obs_content', rejected)}, -1)"), _failed=F.expr(rejected),
        _path=F.expr(stepflags.edited_path("action_type", "content")),
    ).selectExpr("run_id", "index AS position", "_failed", "_path", "_fp")
    found = F.to_json(F.struct(F.col("position").alias("step"), F.expr(stepflags.code_of(name)).alias("code"), F.expr(stepflags.label_of(name)).alias("label")))
    by_section = {0: F.when(F.col("_failed"), F.col("position").cast("string")), 2: F.when(F.col("_fp") >= 0, found),
                  3: F.when(F.col("_path").isNotNull(), _json_string(F.col("_path")))}
    held = F.filter(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("item")) for k, v in by_section.items()]), lambda x: x["item"].isNotNull())
    listed = facts.select("run_id", "position", F.inline(held)).select("run_id", "section", "position", "item")
    commands = repeated_commands(steps).select(
        "run_id", F.lit(1).alias("section"), F.col("first_index").alias("position"), F.to_json(F.struct("command", "count")).alias("item"))
    lines = salient_steps(steps).select("run_id", F.lit(STEPS_SECTION).alias("section"), F.col("index").alias("position"), _line().alias("item"))
    return listed.unionByName(commands).unionByName(lines)


def _fragments(framed: DataFrame) -> DataFrame:
    """``run_id, section, item``: what stands before the lists (section -1) and behind each of them."""
    texts, held = [], []
    for name in _EXPORTED:
        if name not in LISTS:
            held.append(name)
            continue
        texts.append(_fields(held, bool(texts), name))
        held = []
    head = _header(F.col("task_id"), F.col("repo"), F.col("problem_statement"), texts[0], steps=False)
    last = F.concat(_fields(held, True, None), F.lit("\n" + STEPS_HEAD))
    tail = F.concat_ws("\n", F.lit(""), _patch_lines(F.col("final_patch")), _test_lines(
        F.col("test_passed"), *(F.col(c) for c in ("total_tests", "passed_tests", "failed_tests", "raw_log"))))
    pieces = [head, *texts[1:], last, tail]
    return framed.select("run_id", F.posexplode(F.array(*pieces)).alias("section", "item")).withColumn("section", F.col("section") - 1)


def _fields(names: list[str], behind_list: bool, opened: str | None) -> Column:
    """A stretch of the signal record: the end of the list before it, fields, and the begin of the next list."""
    record = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    inner = F.substring(record, F.lit(2), F.length(record) - 2)
    begin = F.lit("]," if behind_list else "{")
    if opened is None:
        return F.concat(begin, inner, F.lit("}"))
    return F.concat(begin, inner, F.lit(("," if names else "") + f'"{opened}":['))


def _chunk_counts(items: DataFrame) -> DataFrame:
    """``run_id, section, chunk, n, parts``: items of each chunk, and the parts that the whole list fills."""
    counts = items.groupBy("run_id", "section", "chunk").agg(F.count("*").alias("n"))
    return counts.withColumn("parts", F.ceil(F.sum("n").over(Window.partitionBy("run_id", "section")) / PART_STEPS))


def _placed(items: DataFrame, counts: DataFrame, filled: DataFrame) -> DataFrame:
    """Items with their ``ordinal`` in their list and the ``part`` they belong to.

    Chunk counts, one row for many steps, carry both: their sums inside a list number its items, and the parts that
    the lists before it fill shift its own.
    """
    earlier = Window.partitionBy("run_id", "section").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("run_id", "section", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")).join(
        filled, "run_id").withColumn("shift", _parts_of(F.col("section") - 1)).drop("filled")
    inside = Window.partitionBy("run_id", "section", "chunk").orderBy("position")
    placed = items.join(offsets, ["run_id", "section", "chunk"]).withColumn("ordinal", F.col("offset") + F.row_number().over(inside) - 1)
    return placed.withColumn("part", F.col("shift") + F.floor(F.col("ordinal") / PART_STEPS) + 1).select(
        "run_id", "section", "part", "ordinal", "item")


def _parts_of(section: Column) -> Column:
    """How many parts the lists up to ``section`` fill, by the map ``filled``."""
    counts = [F.when(section >= k, F.coalesce(F.col("filled")[F.lit(k)], F.lit(0))).otherwise(0) for k in range(STEPS_SECTION + 1)]
    return sum(counts[1:], counts[0])


def compacted_parts(steps: DataFrame, runs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``run_id, part, text`` of every run; joined in order, a run's parts are its whole text.

    ``runs`` has, besides the columns the signals need, ``repo``, ``problem_statement`` and the test result
    (``test_passed, total_tests, passed_tests, failed_tests, raw_log``; ``test_passed`` is null without one). A
    fragment stands at the end of the last part that the lists before it fill.
    """
    items = cut_lineage(_list_items(steps).withColumn("chunk", F.floor(F.col("position") / chunk_rows)))
    counts = _chunk_counts(items)
    # Five lists at most in a run's map.
    filled = counts.groupBy("run_id", "section").agg(F.max("parts").alias("parts")).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("section", "parts"))).alias("filled"))
    comma = F.when(F.col("section") == STEPS_SECTION, "\n").when(F.col("ordinal") > 0, ",").otherwise("")
    listed = _placed(items, counts, filled).select("run_id", "part", "section", "ordinal", F.concat(comma, "item").alias("item"))
    own = runs.select("run_id", "task_id", "repo", "problem_statement", "final_patch", "test_passed", "total_tests", "passed_tests", "failed_tests", "raw_log")
    signals = signals_from_steps(steps, runs)
    framed = own.join(signals.select("run_id", *(c for c in _EXPORTED if c in signals.columns)), "run_id")
    fragments = _fragments(framed).join(filled, "run_id", "left").select(
        "run_id", _parts_of(F.col("section")).alias("part"), "section", F.lit(1 << 62).alias("ordinal"), "item")
    ordered = F.array_sort(F.collect_list(F.struct("section", "ordinal", "item")))
    return listed.unionByName(fragments).groupBy("run_id", "part").agg(
        F.array_join(F.transform(ordered, lambda x: x["item"]), "").alias("text"))


TEXT_COLUMNS = ("task", "steps", "final_patch", "test_result")


def compacted_runs(runs: DataFrame) -> DataFrame:
    """``run_id, text`` of nested runs, row by row."""
    return with_text(signals_from_runs(runs, keep=TEXT_COLUMNS)).select("run_id", "text")


def with_text(signals: DataFrame, wanted: Column | None = None, derived: bool = True) -> DataFrame:
    """Add ``text`` to the signals of nested runs that kept ``TEXT_COLUMNS``; null where not ``wanted``.

    Without ``derived`` the text has the words of ``run_words`` only, no signal record and no test result.
    """
    failed = stepflags.failed("s.action_type", "s.observation IS NOT NULL", "s.observation.exit_code")
    kept = F.expr(f"filter(steps, s -> {is_salient(failed, 's.action_type', 's.index', 'step_count')})")
    cut = computed_once(signals, _signals=signals_json(signals.columns), _kept=kept)

    def line(s: Column, i: Column) -> Column:
        previous = F.get(F.col("_kept"), i - 1)["index"]
        return F.concat(
            _gap(s["index"], previous),
            step_text(
                s["index"], s["action_type"], s["content"], s["observation"]["content"],
                s["observation"].isNotNull(), s["observation"]["exit_code"],
            ),
        )

    t = F.col("test_result")
    tested = _test_lines(t["passed"], t["total_tests"], t["passed_tests"], t["failed_tests"], t["raw_log"])
    record = F.col("_signals") if derived else None
    text = F.concat_ws(
        "\n", _header(F.col("task_id"), F.col("task.repo"), F.col("task.problem_statement"), record),
        F.when(F.size("_kept") > 0, F.array_join(F.transform("_kept", line), "\n")),
        _patch_lines(F.col("final_patch")), *([tested] if derived else []),
    )
    made = text if wanted is None else F.when(wanted, text)
    return cut.withColumn("text", made).drop("_signals", "_kept")


def catalog_text() -> str:
    """The taxonomy as prompt lines."""
    return "\n".join(f"- {c['code']}: {c['definition']}" for c in CATEGORIES)


def prompts(texts: DataFrame, instructions: str = "") -> DataFrame:
    """Put the taxonomy (and any instructions) around each run's text. Parts of a run stay apart; only
    the first one carries the catalog."""
    opening = f"FAILURE TAXONOMY (choose primary from these codes only):\n{catalog_text()}\n\n{instructions}\n\nRUN:\n"
    is_first = F.col("part") == 0 if "part" in texts.columns else F.lit(True)
    return texts.withColumn("text", F.when(is_first, F.concat(F.lit(opening), "text")).otherwise(F.col("text")))

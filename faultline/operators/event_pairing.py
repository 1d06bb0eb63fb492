"""Actions and observations paired on a table with one row per event, for histories of any length.

Whether an action waits before an event is a state of one bit. A pure action sets it, a pure observation clears
it, an event of both kinds flips it, so what a stretch of events does to the bit is again a set, a clear or a
flip: the last pure event in it and the parity of the flips behind that one. Such maps compose.

Each run is cut into chunks of positions. Inside a chunk running windows give every event's map; the chunk as a
whole is one row (its map, and its last event, which may be the waiting action). Running over those rows gives the
bit and the waiting action at every chunk's start, and both are joined back by (run, chunk). So a history may hold
any share of all events: no task sees more than one chunk of it, or one small row for each of its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.barrier import computed_once
from faultline.functions.sequence import with_ordinal
from faultline.operators.normalize_common import step
from faultline.operators.normalize_history import members
from faultline.session import cut_lineage

CHUNK_WIDTH = 4096
END = 1 << 62


def _running(flips: Column, sets: Column, bit: Column, window, name: str, df: DataFrame) -> DataFrame:
    """Add ``{name}_known`` (a pure event was met) and ``{name}_bit`` (the bit behind the row, from 0 at the start)."""
    counted = df.withColumn("_flips", F.sum(F.coalesce(flips.cast("int"), F.lit(0))).over(window))
    # Counts never fall and positions rise, so the last pure event is where both are largest.
    met = counted.withColumn("_met", F.max(F.when(sets, F.struct(F.col("_order"), F.col("_flips"), bit.cast("int").alias("bit")))).over(window))
    parity = (F.coalesce(F.col("_met.bit"), F.lit(0)) + F.col("_flips") - F.coalesce(F.col("_met._flips"), F.lit(0))) % 2
    return met.withColumn(f"{name}_known", F.col("_met").isNotNull()).withColumn(f"{name}_bit", parity == 1).drop("_flips", "_met")


def pair_event_table(events: DataFrame, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """``run_id, index, step`` of an event table.

    ``events`` has ``run_id``, ``pos`` (a number that orders the events of a run, each once; gaps do not matter) and
    what ``plain_event`` or ``sdk_event`` say of an event: ``letter, as_action, alone, text, seen, raw``. A chunk spans
    ``chunk_width`` positions.
    """
    # Written once, in the order they came: the events are read three times, and taking them apart costs more.
    placed = cut_lineage(events.withColumn("chunk", F.floor(F.col("pos") / chunk_width)).withColumn("_order", F.col("pos")))
    linked = placed.filter("letter != 'N'")
    inside = Window.partitionBy("run_id", "chunk").orderBy("pos")
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letter = F.col("letter")
    ran = _running(letter == "B", letter != "B", letter == "A", here, "own", linked)

    # One row a chunk: what it does to the bit, and its last event.
    event = F.struct("as_action", "text", "raw")
    chunks = ran.groupBy("run_id", "chunk").agg(
        F.max_by(F.struct("own_known", "own_bit", event.alias("event")), "pos").alias("last")
    ).select("run_id", "chunk", F.col("chunk").alias("_order"), "last.*")
    along = Window.partitionBy("run_id").orderBy("chunk")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = _running(~F.col("own_known") & F.col("own_bit"), F.col("own_known"), F.col("own_bit"), so_far, "run", chunks)
    carried = chunks.select(
        "run_id", "chunk", F.coalesce(F.lag("run_bit").over(along), F.lit(False)).alias("enters"),
        F.lag("event").over(along).alias("carried"))

    met = ran.join(carried, ["run_id", "chunk"])
    behind = F.when(F.col("own_known"), F.col("own_bit")).otherwise(F.col("own_bit") != F.col("enters"))
    met = met.withColumn("_behind", behind).select(
        "*", F.coalesce(F.lag("_behind").over(inside), F.col("enters")).alias("waits"),
        F.coalesce(F.lag(event).over(inside), F.col("carried")).alias("before"))
    before, waits = F.col("before"), F.col("waits")
    answered = step(before["as_action"], before["text"], F.col("seen"), F.create_map(F.lit("raw_action_type"), before["raw"]))
    made = F.when(waits & (letter == "A"), _unanswered(before)).when(waits, answered).when(letter == "O", _alone())
    paired = met.select("run_id", "chunk", "pos", F.inline(_kept(made)))
    others = placed.filter("letter = 'N'").select("run_id", "chunk", "pos", F.inline(_kept(_alone())))
    last = chunks.withColumn("_next", F.lead("chunk").over(along)).filter("_next IS NULL AND run_bit").select(
        "run_id", F.lit(END).alias("chunk"), F.lit(END).alias("pos"), _unanswered(F.col("event")).alias("step"))
    emitted = cut_lineage(paired.unionByName(others).unionByName(last))
    return with_ordinal(emitted, ["run_id"], "chunk", ["pos"]).select("run_id", "index", "step")


def _unanswered(event: Column) -> Column:
    return step(event["as_action"], event["text"], F.lit(None))


def _alone() -> Column:
    return step(F.col("alone"), F.col("text"), F.col("seen"))


def _kept(made: Column) -> Column:
    """An array of the step, empty where there is none: its expression is then not copied into a filter."""
    return F.filter(F.array(F.struct(made.alias("step"))), lambda x: x["step"].isNotNull())


def event_rows(events: DataFrame, read, event: str = "event") -> DataFrame:
    """``run_id, pos`` and the description of each event, from rows with a VARIANT ``event``.

    ``read`` is ``plain_event`` or ``sdk_event``.
    """
    read_once = computed_once(events.select("run_id", "pos", event), _members=members(F.col(event), F.col("pos")))
    described = computed_once(read_once, _event=read(F.col("_members")))
    return described.select("run_id", "pos", *(f"_event.{c}" for c in ("letter", "as_action", "alone", "text", "seen", "raw")))


def step_rows(steps: DataFrame) -> DataFrame:
    """The columns of a steps table from ``run_id, index, step``."""
    s = F.col("step")
    return steps.select(
        "run_id", "index", s["action_type"].alias("action_type"), s["content"].alias("content"),
        s["observation"].isNotNull().alias("has_obs"), s["observation"]["content"].alias("obs_content"),
        s["observation"]["exit_code"].alias("exit_code"))

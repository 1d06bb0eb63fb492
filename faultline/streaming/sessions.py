"""Signals of runs whose steps arrive in pieces, out of order and late.

A run's steps form event-time sessions: a session ends when nothing came for ``gap``, and is written once the
watermark has passed that end. Its state are the same numbers that fold a steps table (sums, first and last places),
which merge in any order, and one 64-bit digest for each command or opened file, from which repeated commands and
distinct files are counted when the session closes. Steps later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.arrays import group_starts, let
from faultline.operators.signals import FOLDED, REPEATED, derive, own_facts, step_facts

SESSION = ("run_id", "session_start", "session_end")


def _repeated(commands: Column) -> Column:
    """How many of the digests occur at least ``REPEATED`` times."""
    return let(F.array_sort(commands), lambda o: let(
        group_starts(o, lambda c: c),
        lambda starts: F.size(F.filter(
            F.slice(F.transform(starts, lambda s, i: F.get(starts, i + 1) - s), 1, F.greatest(F.size(starts) - 1, F.lit(0))),
            lambda n: n >= REPEATED))))


def step_sessions(steps: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """``run_id, session_start, session_end`` and the folded numbers of each session of a steps table with ``ts``.

    With ``watermark`` the input may be a stream; sessions then come when they are closed. ``session_end`` is the
    last step's time plus ``gap``.
    """
    timed = steps.withColumn("ts", F.col("ts").cast("timestamp"))
    facts = step_facts(timed, "ts").withColumn("_digest", F.xxhash64("item"))
    if watermark:
        facts = facts.withWatermark("ts", watermark)
    is_opened = F.substring("item", 1, 1) == "r"
    folded = facts.groupBy("run_id", F.session_window("ts", gap).alias("session")).agg(
        *[F.expr(f"{e} AS {n}") for part in FOLDED for n, e in part.items()],
        F.collect_list(F.when(is_opened, F.col("_digest"))).alias("_opened"),
        F.collect_list(F.when(~is_opened, F.col("_digest"))).alias("_commands"),
    )
    return folded.select(
        "run_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
        *[n for part in FOLDED for n in part], F.size(F.array_distinct("_opened")).alias("unique_files_opened"),
        _repeated(F.col("_commands")).alias("n_repeated_commands"))


def session_signals(steps: DataFrame, runs: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """The signals of each closed session, with ``session_start`` and ``session_end``.

    ``runs`` is a table with the runs' own columns; a run that is not in it yet has its steps' signals only.
    """
    sessions = step_sessions(steps, gap, watermark)
    known = sessions.join(own_facts(runs), "run_id", "left")
    filled = known.fillna(False, ["produced_patch", "catastrophic_edit", "framework_error"])
    return derive(filled, SESSION[1:])

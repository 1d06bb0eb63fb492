"""Repair of damaged conversations by their cheapest edits.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles: an optional system row, then user and
assistant in turn. Rows are kept, given the other role, deleted, or empty rows inserted; of the cheapest ways the
one whose edits' initials are least in ASCII counts.

After the rows read so far there are four states: nothing written, a system row, a user row, an assistant row.
A row, a chunk of rows and a whole conversation are the same thing, a **step**: for each state before and after,
the least cost and the rank of its edits among those that start in the same state. Edits of a step end with its
last row, so none is a beginning of another and ranks order them strictly; steps therefore join to steps.

To find the states between the rows of a chunk, Hirschberg's divide and conquer: a forward vector of four costs
(and ranks) and a backward one meet in the middle, the least-audit optimal crossing is chosen, and both halves go
on alone, in space linear in the chunk. The same halving finds the states between chunks. So a conversation of any
length is split: chunks become steps, 256 steps become one step, and so on; states come back the same way.

Costs, faults and edits are fixed by the rules below; texts move only to be handed out again.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import slices, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # what edits cost, and what a truncated row adds if it stays
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a row of a role, by the state before it.
NEXT_USER, NEXT_ASSISTANT = {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}
AFTER = {"s": {START: SYSTEM}, "u": NEXT_USER, "a": NEXT_ASSISTANT, "o": {}}
#: A row as one letter: its role's initial (o: any other), a capital if truncated, a digit if it must go.
SOUND, SHORT, BAD = "suao", "SUAO", "0123"
#: Bits of a row's place that its piece leaves out, by level: 4096 rows, 256 such pieces, and so on.
SHIFTS = (12, 20, 28, 36, 44, 52, 60)
FAR = 1 << 62
WHITE = " \t\n\x0b\x0c\r"

Cell = tuple[int, int]  # cost, rank
Step = tuple[tuple[Cell | None, ...], ...]


def _inserts(state: int) -> Iterator[tuple[int, str]]:
    """States that empty rows lead to, with those edits; more than two are never cheapest."""
    yield state, ""
    first = USER if state != USER else ASSISTANT
    yield first, "I"
    yield (ASSISTANT if first == USER else USER), "II"


@lru_cache(maxsize=None)
def row_edits(letter: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """Cost and edits of one row, with inserts before it, for each state before and after: the cheapest, then least."""
    table = [[None] * 4 for _ in STATES]
    for state in STATES:
        for at, edits in _inserts(state):
            ways = [(DELETE, "D", at)]
            if letter not in BAD:
                extra = TRUNCATED if letter in SHORT else 0
                if (after := AFTER[letter.lower()].get(at)) is not None:
                    ways.append((KEEP + extra, "K", after))
                ways.append((REROLE + extra, "R", ASSISTANT if at == USER else USER))
            for cost, edit, after in ways:
                way = (cost + INSERT * len(edits), edits + edit)
                if table[state][after] is None or way < table[state][after]:
                    table[state][after] = way
    return tuple(map(tuple, table))


#: Inserts after the last row, to end with nothing or with an assistant row.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def _ranked(cells: list[tuple | None]) -> tuple[Cell | None, ...]:
    """(cost, sort key) per state after, with the key's rank in its place."""
    order = {key: i for i, key in enumerate(sorted({c[1] for c in cells if c}))}
    return tuple(c and (c[0], order[c[1]]) for c in cells)


@lru_cache(maxsize=None)
def row_step(letter: str) -> Step:
    return tuple(_ranked(list(row)) for row in row_edits(letter))


def _extended(vector: tuple[Cell | None, ...], step: Step) -> tuple[Cell | None, ...]:
    """The vector of costs and ranks after one more step."""
    out: list[tuple | None] = [None] * 4
    for cell, row in zip(vector, step):
        if cell is None:
            continue
        for after, more in enumerate(row):
            if more is None:
                continue
            way = (cell[0] + more[0], (cell[1], more[1]))
            if out[after] is None or way < out[after]:
                out[after] = way
    return _ranked(out)


def _begin(state: int) -> tuple[Cell | None, ...]:
    return tuple((0, 0) if s == state else None for s in STATES)


def joined(steps: list[Step]) -> Step:
    """One step for several."""
    rows = []
    for state in STATES:
        vector = _begin(state)
        for step in steps:
            vector = _extended(vector, step)
        rows.append(vector)
    return tuple(rows)


def crossings(steps: list[Step], before: int, after: int) -> list[int]:
    """The states behind each step, on the cheapest and then least way from ``before`` to ``after``."""
    if len(steps) <= 1:
        return [after] * len(steps)
    middle = len(steps) // 2
    forward = _begin(before)
    for step in steps[:middle]:
        forward = _extended(forward, step)
    backward = [0 if s == after else FAR for s in STATES]
    for step in reversed(steps[middle:]):
        backward = [min((c[0] + b for c, b in zip(row, backward) if c is not None), default=FAR) for row in step]
    _, _, state = min((c[0] + backward[s], c[1], s) for s, c in enumerate(forward) if c is not None)
    return crossings(steps[:middle], before, state) + crossings(steps[middle:], state, after)


@lru_cache(maxsize=20_000)
def _short_step(letters: str) -> Step:
    return joined([row_step(x) for x in letters])


@lru_cache(maxsize=20_000)
def _short_edits(letters: str, before: int, after: int) -> tuple[str, ...]:
    states = crossings([row_step(x) for x in letters], before, after)
    return tuple(row_edits(x)[a][b][1] for x, a, b in zip(letters, [before, *states], states))


def step_of(letters: str) -> Step:
    """The step of a chunk of rows; short chunks repeat and are kept."""
    return _short_step(letters) if len(letters) <= 64 else _short_step.__wrapped__(letters)


def edits_of(letters: str, before: int, after: int) -> tuple[str, ...]:
    """The edits of each row of a chunk, inserts before the row's own."""
    return _short_edits(letters, before, after) if len(letters) <= 64 else _short_edits.__wrapped__(letters, before, after)


def last_state(step: Step) -> tuple[int, int]:
    """Cost of a whole conversation and the state behind its last row."""
    cost, _, state = min((c[0] + TAIL[s][0], c[1], s) for s, c in enumerate(step[START]) if c is not None)
    return cost, state


STEP = "array<array<long>>"  # four rows of cost, rank, cost, rank...; -1 where there is no way


def _flat(step: Step) -> list[list[int]]:
    return [[x for c in row for x in (c or (-1, -1))] for row in step]


def _step(flat: list[list[int]]) -> Step:
    return tuple(tuple(None if row[i] < 0 else (row[i], row[i + 1]) for i in range(0, 8, 2)) for row in flat)


def illegal_pairs(initials: str) -> int:
    return sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:]))


# Rows


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            every: int = 20) -> DataFrame:
    """(conv, turn, role, text) with faults planted by crc32 of ``conv:turn``, modulo ``every``.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user. Null roles and
    texts become one space, as do nulls inside the hashed text; conv and turn themselves stay null.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    fault = F.crc32(name.cast("binary")) % every
    body = F.coalesce(F.col(text), F.lit(" "))
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                                body.alias("text"), fault.alias("fault"))
    rows = rows.filter("fault != 0").select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


ORDER = ["turn", "role", "digest"]
FAULTS = ("blank", "duplicate", "truncated")


def _whole(rows: DataFrame) -> DataFrame:
    """Rows with their place's last key, the text's digest; nulls in role and text become empty."""
    return rows.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def marked(rows: DataFrame, parts: int) -> DataFrame:
    """Rows without their texts, in order: (conv, turn, role, digest, at, initial, fault), written once.

    A conversation's rows are dealt over as many ranges as it fills. ``at`` numbers them from 0 along (turn, role,
    digest): a range's rows have consecutive numbers, which the counts of the conversation's earlier ranges shift.
    ``fault`` is blank, duplicate, truncated or null. A duplicate is found by its group's first place, counted
    before the shuffle; only groups of more than one row meet the rows again.
    """
    body = F.rtrim("text", F.lit(WHITE))
    plain = _whole(rows).select(
        "conv", *ORDER, (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"))
    plain = written(plain.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in ("conv", *ORDER, "row")]
    dealt = written(plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
                    .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    counts = dealt.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("conv").alias("_conv"), F.col("range").alias("_range"),
                           (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("shift"))
    dealt = dealt.join(shifts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range"))).withColumn(
        "at", F.col("at") - F.col("shift")).drop("_conv", "_range", "range", "shift")
    seen = dealt.filter("not blank").groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    seen = seen.filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in ("conv", "role", "digest")), "first")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("truncated"), "truncated")
    initial = F.substring("role", 1, 1)
    return written(dealt.join(seen, same & ~F.col("blank"), "left").select(
        "conv", *ORDER, "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault")))


def _letter() -> Column:
    """A row's initial and fault as one letter."""
    return (F.when(F.col("fault").isNull(), F.col("initial")).when(F.col("fault") == "truncated", F.upper("initial"))
            .otherwise(F.translate("initial", SOUND, BAD)))


def chunks_of(rows: DataFrame) -> DataFrame:
    """(conv, piece, first, letters, step, illegal, ends) of chunks of at most 4096 rows of a conversation.

    ``illegal`` counts neighbours inside the chunk, ``ends`` are its first and last initial.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", _letter().alias("letter"))))
    chunks = rows.groupBy("conv", F.shiftright("at", SHIFTS[0]).alias("piece")).agg(
        F.min("at").alias("first"), ordered.alias("rows"))
    chunks = chunks.select("conv", "piece", "first", F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("letters"))
    kind = chunks.schema["conv"].dataType.simpleString()
    plain = str.maketrans("SUAO0123", "suaosuao")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            letters = batch.column("letters").to_pylist()
            initials = [x.translate(plain) for x in letters]
            new = {"step": [_flat(step_of(x)) for x in letters], "illegal": [illegal_pairs(x) for x in initials],
                   "ends": [x[0] + x[-1] for x in initials]}
            yield _with(batch, new)

    return written(chunks.mapInArrow(
        fold, f"conv {kind}, piece long, first long, letters string, step {STEP}, illegal long, ends string"))


ARROW = {"step": pa.list_(pa.list_(pa.int64())), "illegal": pa.int64(), "ends": pa.string(), "before": pa.int32(), "after": pa.int32(),
         "cost": pa.int64(), "edits": pa.list_(pa.string())}


def _with(batch: pa.RecordBatch, new: dict[str, list]) -> pa.RecordBatch:
    arrays = [*batch.columns, *(pa.array(v, ARROW[k]) for k, v in new.items())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *new])


def _up(pieces: DataFrame, level: int) -> DataFrame:
    """Neighbouring pieces of a level, joined to steps of the next."""
    members = F.array_sort(F.collect_list(F.struct("piece", "step", "illegal", "ends")))
    groups = pieces.groupBy("conv", F.shiftright("piece", SHIFTS[level + 1] - SHIFTS[level]).alias("up")).agg(members.alias("members")).withColumnRenamed("up", "piece")
    kind = groups.schema["conv"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            new: dict[str, list] = {"step": [], "illegal": [], "ends": []}
            for members in batch.column("members").to_pylist():
                new["step"].append(_flat(joined([_step(m["step"]) for m in members])))
                inner = sum(illegal_pairs(p["ends"][1] + q["ends"][0]) for p, q in zip(members, members[1:]))
                new["illegal"].append(inner + sum(m["illegal"] for m in members))
                new["ends"].append(members[0]["ends"][0] + members[-1]["ends"][1])
            yield _with(batch.select(["conv", "piece"]), new)

    return written(groups.mapInArrow(fold, f"conv {kind}, piece long, step {STEP}, illegal long, ends string"))


def _down(pieces: DataFrame, solved: DataFrame, level: int) -> DataFrame:
    """(conv, piece, before, after): states around each piece, from those around the steps one level up."""
    kind = pieces.schema["conv"].dataType.simpleString()
    members = F.array_sort(F.collect_list(F.struct("piece", "step")))
    groups = pieces.groupBy("conv", F.shiftright("piece", SHIFTS[level + 1] - SHIFTS[level]).alias("up")).agg(members.alias("members"))
    above = solved.select(F.col("conv").alias("_conv"), F.col("piece").alias("_up"), "before", "after")
    groups = groups.join(above, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("up") == F.col("_up")))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            at, piece, before, after = [], [], [], []
            for i, row in enumerate(batch.select(["members", "before", "after"]).to_pylist()):
                states = crossings([_step(m["step"]) for m in row["members"]], row["before"], row["after"])
                at += [i] * len(states)
                piece += [m["piece"] for m in row["members"]]
                before += [row["before"], *states[:-1]]
                after += states
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(pa.array(at, pa.int64())), pa.array(piece, pa.int64()), pa.array(before, pa.int32()),
                 pa.array(after, pa.int32())], names=["conv", "piece", "before", "after"])

    return written(groups.select("conv", "members", "before", "after").mapInArrow(
        cross, f"conv {kind}, piece long, before int, after int"))


def _ended(roots: DataFrame) -> DataFrame:
    """(conv, piece, illegal, before, after, cost) of conversations that are one piece."""
    kind = roots.schema["conv"].dataType.simpleString()

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [last_state(_step(s)) for s in batch.column("step").to_pylist()]
            yield _with(batch.select(["conv", "piece", "illegal"]),
                        {"before": [START] * len(found), "after": [f[1] for f in found], "cost": [f[0] for f in found]})

    return roots.select("conv", "piece", "illegal", "step").mapInArrow(
        end, f"conv {kind}, piece long, illegal long, before int, after int, cost long")


def solved(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, piece, first, edits) for each chunk, an entry for each row, and (conv, illegal, cost) for each conversation."""
    levels, single = [chunks], []
    while True:
        pieces = levels[-1]
        alone = pieces.groupBy("conv").agg(F.count("*").alias("n"), F.min("piece").alias("_piece"))
        one = alone.filter("n = 1").select(F.col("conv").alias("_conv"), "_piece")
        same = F.col("conv").eqNullSafe(F.col("_conv"))
        single.append(written(_ended(pieces.join(one, same & (F.col("piece") == F.col("_piece")), "left_semi"))))
        more = pieces.join(one, same, "left_anti")
        if more.isEmpty():
            break
        levels[-1] = written(more) if len(levels) > 1 else more
        levels.append(_up(more, len(levels) - 1))
    ends = single[-1]
    for level in range(len(levels) - 2, -1, -1):
        states = _down(levels[level], ends.select("conv", "piece", "before", "after"), level)
        ends = states.unionByName(single[level].select("conv", "piece", "before", "after"))
    per_conversation = single[0].select("conv", "illegal", "cost")
    for more in single[1:]:
        per_conversation = per_conversation.unionByName(more.select("conv", "illegal", "cost"))
    kind = chunks.schema["conv"].dataType.simpleString()
    around = ends.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), "before", "after")
    placed = chunks.select("conv", "piece", "first", "letters").join(
        around, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))

    def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            states = zip(*(batch.column(c).to_pylist() for c in ("letters", "before", "after")))
            yield _with(batch.select(["conv", "piece", "first"]), {"edits": [edits_of(*s) for s in states]})

    edits = placed.select("conv", "piece", "first", "letters", "before", "after").mapInArrow(
        recover, f"conv {kind}, piece long, first long, edits array<string>")
    return written(edits), per_conversation


def _role_after(state: int) -> str:
    return "assistant" if state == USER else "user"


def applied(edits: str, state: int, role: str, text: str) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of one row's edits from a state, and the state behind them."""
    out = []
    for edit in edits:
        if edit == "D":
            out.append((edit, role, text))
        elif edit == "K":
            out.append((edit, role, text))
            state = AFTER[role[0]][state]
        else:
            new = _role_after(state)
            out.append((edit, new, text if edit == "R" else ""))
            state = ASSISTANT if new == "assistant" else USER
    return out, state


def repaired(rows: DataFrame, ordered: DataFrame, edits: DataFrame, parts: int) -> DataFrame:
    """(conv, edit, role, text), one row an edit, each conversation in order within one partition.

    A deleted row keeps its role and text, an inserted one has an empty text. Texts and chunks of edits meet in one
    shuffle by conversation and are read as a stream: a chunk's edits come just before its first row, so a task holds
    one chunk, whatever the length of the conversation.
    """
    first = edits.select(F.col("conv").alias("_conv"), F.col("first").alias("_first"), "piece", "edits")
    heads = ordered.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_first")))
    both = heads.select("conv", *ORDER, "piece", F.lit("").alias("text"), "edits").unionByName(
        _whole(rows).select("conv", *ORDER, F.lit(None).cast("long").alias("piece"), "text", F.lit(None).cast("array<string>").alias("edits")))
    order = [F.col(c).asc_nulls_first() for c in ("conv", *ORDER)] + [F.col("piece").asc_nulls_last()]
    streamed = both.repartition(parts, "conv").sortWithinPartitions(*order).select("conv", "role", "text", "edits")
    kind = both.schema["conv"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[str] = deque()
        state, current, conv_type = START, None, None

        def handed(out: list[tuple]) -> pa.RecordBatch:
            conv, edit, role, text = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), *(pa.array(x, pa.string()) for x in (edit, role, text))],
                                              names=["conv", "edit", "role", "text"])

        def tail() -> list[tuple]:
            return [] if current is None else [(current[0], *e) for e in applied(TAIL[state][1], state, "", "")[0]]

        for batch in slices(batches, 1024):
            conv_type, out = batch.schema.field("conv").type, []
            for conv, role, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    out += tail()
                    current, state = (conv,), START
                if own is not None:
                    waiting.extend(own)
                    continue
                done, state = applied(waiting.popleft(), state, role, text)
                out += [(conv, *e) for e in done]
            yield handed(out)
        if current is not None:
            yield handed(tail())

    return streamed.mapInArrow(apply, f"conv {kind}, edit string, role string, text string")


def digests(edited: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) from rows that come as ``repaired`` gives them; a stream, no shuffle."""
    kind = edited.schema["conv"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, sha, conv_type = None, [], None, None

        def handed(out: list[tuple]) -> pa.RecordBatch:
            conv, audits, shas = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), pa.array(audits, pa.string()), pa.array(shas, pa.string())],
                                              names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            conv_type, out = batch.schema.field("conv").type, []
            for conv, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    if current is not None:
                        out.append((current[0], "".join(audit), sha.hexdigest()))
                    current, audit, sha, some = (conv,), [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    sha.update(f"{'\n' if some else ''}{role}:{text}".encode())
                    some = True
            yield handed(out)
        if current is not None:
            yield handed([(current[0], "".join(audit), sha.hexdigest())])

    return edited.select("conv", "edit", "role", "text").mapInArrow(fold, f"conv {kind}, audit string, repaired_sha256 string")


def faults(ordered: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of each conversation, by counts that combine before their shuffle."""
    turns = ordered.groupBy("conv", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in FAULTS))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in FAULTS))


def repair(rows: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """The edited rows (see ``repaired``), and (conv, gaps, blank, duplicate, truncated, illegal, cost).

    ``rows`` has conv, turn, role, text. Rows stand by turn, null first; rows of one turn by role, then by digest of
    the text. Nulls in role and text count as empty; a null conv is a conversation of its own; an empty table gives
    no rows. A row's first fault counts: blank (only white space), duplicate (role and text seen earlier in the
    conversation), truncated (does not end with ``.!?``).
    """
    ordered = marked(rows, parts)
    edits, totals = solved(chunks_of(ordered))
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    report = faults(ordered).join(totals.withColumnRenamed("conv", "_conv"), same).drop("_conv")
    return repaired(rows, ordered, edits, parts), report


def repair_damaged(conversations: DataFrame, parts: int, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Every conversation of the table after planted damage and repair: faults, cost, audit and digest.

    A conversation that lost all its rows has zeros, an empty audit and the digest of the empty text. Other columns
    are not read.
    """
    edited, report = repair(damaged(conversations, conv, turn, role, text), parts)
    every = conversations.select(F.col(conv).alias(conv)).groupBy(conv).agg(F.lit(1).alias("_one"))
    for more in (report, digests(edited)):
        every = every.join(more.withColumnRenamed("conv", "_conv"), F.col(conv).eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = ("gaps", *FAULTS, "illegal", "cost")
    return every.select(conv, *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

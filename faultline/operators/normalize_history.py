"""Event-history logs (actions and observations as separate events) to runs.

An observation answers the action still waiting; an action that meets a waiting one pushes it out
unanswered; other events stand alone. Whether an action is waiting depends on the whole prefix, but
only through the last *pure* action or observation and the number of events of both kinds since:

    events as letters, "neither" left out      A O B B A B O
    cut before every A and O                   A | O B B | A B | O

Inside a piece the state alternates, and a piece starts from the end state of the one before. So one
regex cut and array lookups pair the events inside the record's own row, linear in its length: no
shuffle, no window and no task that holds more than its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import let
from faultline.functions.barrier import computed_once
from faultline.functions.text import lookup, not_blank, strip
from faultline.operators.normalize_common import numbered, observation, step, task, to_runs
from faultline.schema import STEP

AGENT = "openhands"
END = (1 << 31) - 1  # behind all positions of a history

# Event type names and the step type they stand for.
EVENT_TYPES = {
    "message": "message",
    "think": "message",
    "run": "command",
    "cmd_run": "command",
    "run_ipython": "command",
    "edit": "file_edit",
    "file_edit": "file_edit",
    "str_replace_editor": "file_edit",
    "write": "file_edit",
    "read": "file_read",
    "file_read": "file_read",
    "browse": "browse",
    "browse_interactive": "browse",
    "finish": "finish",
    "error": "error",
}
# Where an event's text is looked for, in order.
CONTENT_KEYS = ("command", "code", "content", "thought", "message", "path", "args")
CONTENT_SUBKEYS = ("command", "code", "content", "path")
OBSERVATION_KEYS = ("content", "message", "output")


def action_type(name: Column, extra_types: dict[str, str] | None = None) -> Column:
    return lookup({**EVENT_TYPES, **(extra_types or {})}, F.lower(name), "unknown")


def _nonblank(text: Column) -> Column:
    return F.when(not_blank(text), text)


# The members of an event that are looked at.
MEMBERS = (
    "action", "observation", "source", "type", "command", "code", "content", "thought", "message", "path", "args",
    "output", "exit_code",
)


_MEMBERS_TYPE = "struct<" + ",".join(f"`{key}`:variant" for key in (*MEMBERS, "extras")) + ">"


def members(event: Column, position: Column) -> Column:
    """The event's members with value, JSON type and text, taken apart in one go; null where absent."""

    return let(F.try_variant_get(event, "$", _MEMBERS_TYPE), lambda e: _described(e, position))


def _described(e: Column, position: Column) -> Column:
    def member(v: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(v.alias("value"), j.kind(v).alias("kind"), j.text_of(v).alias("text")))

    return F.struct(position.alias("pos"), *[member(e[key]).alias(key) for key in MEMBERS], e["extras"].alias("extras"))


def _string(member: Column) -> Column:
    return F.when(member["kind"] == "STRING", member["text"])


def _truthy_text(member: Column) -> Column:
    """The member's text if it counts as true (numbers are no names and count as such)."""
    empty = member["text"].isin("", "false", "[]", "{}", "0")
    return F.when((member["kind"] != "VOID") & ~empty, member["text"])


def event_text(m: Column, replaced: dict[str, Column] | None = None) -> Column:
    """The first non-blank text among the content keys, looking one level into objects; else the
    arguments as JSON."""
    replaced = replaced or {}
    candidates = []
    for key in CONTENT_KEYS:
        if key in replaced:
            candidates.append(let(replaced[key], _nonblank))
            continue
        inner = [_nonblank(j.string_at(m[key]["value"], f"$.{sub}")) for sub in CONTENT_SUBKEYS]
        candidates.append(
            F.when(m[key]["kind"] == "STRING", _nonblank(m[key]["text"])).when(
                m[key]["kind"].startswith("OBJECT"), F.coalesce(*inner)
            )
        )
    rendered = F.when(_truthy_text(m["args"]).isNotNull(), j.spaced_json(
        F.when(m["args"]["kind"] == "STRING", F.to_json(m["args"]["value"])).otherwise(m["args"]["text"])
    ))
    return F.coalesce(*candidates, rendered, F.lit(""))


def event_observation(m: Column) -> Column:
    """The event as an observation: its first text and the last valid exit code; null without both."""
    content = F.coalesce(*[_string(m[key]) for key in OBSERVATION_KEYS], F.lit(""))
    own = F.when(m["exit_code"]["kind"].isNotNull(), j.integer_of(m["exit_code"]["value"]))
    code = F.when(m["extras"].isNotNull(), F.coalesce(j.integer_of(j.child(m["extras"], "$.exit_code")), own)).otherwise(own)
    extra = F.coalesce(F.try_variant_get(m["extras"], "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return let(
        F.struct(content.alias("content"), code.alias("code")),
        lambda o: F.when(
            (F.length(o["content"]) > 0) | o["code"].isNotNull(), observation(o["content"], o["code"], extra)
        ),
    )


def _first_name(*found: Column) -> Column:
    return F.coalesce(*[_truthy_text(m) for m in found], F.lit(""))


def plain_event(m: Column, extra_types: dict[str, str] | None = None) -> Column:
    """What pairing needs to know of one event (its ``members``)."""
    return _event(
        m["pos"],
        acts=m["action"]["kind"].isNotNull() | m["source"]["text"].eqNullSafe("agent"),
        observes=m["observation"]["kind"].isNotNull() | m["source"]["text"].eqNullSafe("environment"),
        as_action=action_type(_first_name(m["action"], m["type"]), extra_types),
        alone=action_type(_first_name(m["action"], m["observation"], m["type"]), extra_types),
        text=event_text(m), seen=event_observation(m), raw=m["action"]["text"],
    )


def sdk_event(m: Column, extra_types: dict[str, str] | None = None) -> Column:
    """The same for events whose action is an object with a ``kind`` and whose texts are block lists."""
    structured = F.coalesce(m["action"]["kind"].startswith("OBJECT"), F.lit(False))

    def named(kind: Column) -> Column:
        return F.lower(F.when(kind.endswith("Action"), F.replace(kind, F.lit("Action"), F.lit(""))).otherwise(kind))

    kind = F.when(structured, let(F.coalesce(j.text_of(m["action"]["value"], "$.kind"), F.lit("")), named))
    return let(kind, lambda kind: _sdk_event(m, structured, kind, extra_types))


def _sdk_event(m: Column, structured: Column, kind: Column, extra_types: dict[str, str] | None) -> Column:
    def flattened(key: str) -> Column:
        own, inner = m[key]["value"], j.child(m["action"]["value"], f"$.{key}")
        return F.when(structured, block_text(F.coalesce(own, inner))).otherwise(_string(m[key]))

    name = F.when(
        structured, F.coalesce(F.nullif(kind, F.lit("")), _truthy_text(m["type"]), F.lit(""))
    ).otherwise(_first_name(m["action"], m["type"]))
    seen_name = F.when(
        m["observation"]["kind"].startswith("OBJECT"), j.string_at(m["observation"]["value"], "$.content")
    ).otherwise(_truthy_text(m["observation"]))
    alone = F.when(structured, name).otherwise(
        F.coalesce(_truthy_text(m["action"]), F.nullif(seen_name, F.lit("")), _truthy_text(m["type"]), F.lit(""))
    )
    return _event(
        m["pos"],
        acts=m["action"]["kind"].isNotNull() | m["source"]["text"].eqNullSafe("agent"),
        observes=m["observation"]["kind"].isNotNull() | m["source"]["text"].eqNullSafe("environment"),
        as_action=action_type(name, extra_types), alone=action_type(alone, extra_types),
        text=event_text(m, {k: flattened(k) for k in ("thought", "message")}),
        seen=event_observation(m), raw=F.when(structured, kind).otherwise(m["action"]["text"]),
    )


def with_events(records: DataFrame, history: Column, read, extra_types: dict[str, str] | None) -> DataFrame:
    """Read the members of every event once, then describe the events by them. ``history`` is an array of
    the members' own type, taken out of the record in one go."""
    read_once = computed_once(records, _members=F.transform(history, _described))
    return computed_once(read_once, events=F.transform("_members", lambda m: read(m, extra_types))).drop("_members")


def _event(position, acts, observes, as_action, alone, text, seen, raw) -> Column:
    letter = F.when(acts & observes, "B").when(acts, "A").when(observes, "O").otherwise("N")
    # An event that acts is never a step alone, one that does not is never answered, and a pure action answers none.
    # The letter is not bound by ``let``, which would copy the whole event once more.
    return F.struct(
        position.alias("pos"), letter.alias("letter"), F.when(acts, as_action).alias("as_action"),
        F.when(~acts, alone).alias("alone"), text.alias("text"), F.when(~acts | observes, seen).alias("seen"),
        F.when(acts, raw).alias("raw"),
    )


def block_text(value: Column) -> Column:
    """Plain text of a string or of a list of content blocks; tool calls are left out."""
    blocks = F.filter(
        j.array_at(value, "$"),
        lambda b: ~(j.is_object(b) & F.coalesce(j.string_at(b, "$.type") == "tool_use", F.lit(False))),
    )
    texts = F.transform(blocks, lambda b: F.when(j.is_object(b), F.coalesce(j.text_of(b, "$.text"), F.lit(""))).otherwise(j.text_of(b)))
    joined = strip(F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " "))
    return F.when(j.is_string(value), j.text_of(value)).when(j.is_array(value), joined).otherwise("")


def pair_events(records: DataFrame, events: str = "events", result: str = "steps") -> DataFrame:
    """Replace the event array of each record by its steps.

    The arrays that lambdas index into are computed in a step of their own, once per record."""
    # 1. Leave out events of neither kind and cut the letters into pieces.
    linked = computed_once(records, _linked=F.filter(events, lambda e: e["letter"] != "N"))
    letters = F.array_join(F.transform("_linked", lambda e: e["letter"]), "")
    cut = computed_once(linked, _pieces=F.regexp_extract_all(letters, F.lit("[AO]B*|B+"), F.lit(0)))

    # 2. Per piece: is an action waiting after its first letter, and after its last?
    def first_waits(piece: Column) -> Column:
        # A leading piece of B only starts by acting, as an A does.
        return ~piece.startswith("O")

    def last_waits(piece: Column) -> Column:
        return (first_waits(piece).cast("int") + F.length(piece) - 1) % 2 == 1

    def before(piece: Column, i: Column) -> Column:
        """For each letter of the piece: was an action waiting before it?"""
        enters = F.when(i > 0, last_waits(F.get(F.col("_pieces"), i - 1))).otherwise(False)
        return F.transform(
            F.sequence(F.lit(0), F.length(piece) - 1),
            lambda at: F.when(at == 0, enters).otherwise((first_waits(piece).cast("int") + at - 1) % 2 == 1),
        )

    waiting = F.when(F.size("_pieces") > 0, F.flatten(F.transform("_pieces", before))).otherwise(F.array().cast("array<boolean>"))
    known = computed_once(cut, _waiting=waiting)

    # 3. Each event emits at most one step, at its own position.
    def unanswered(e: Column) -> Column:
        return step(e["as_action"], e["text"], F.lit(None))

    def emit(e: Column, i: Column) -> Column:
        waits, last = F.get(F.col("_waiting"), i), F.get(F.col("_linked"), i - 1)
        answered = step(
            last["as_action"], last["text"], e["seen"], F.create_map(F.lit("raw_action_type"), last["raw"])
        )
        made = F.when(
            waits, F.when(e["letter"] == "A", unanswered(last)).otherwise(answered)
        ).when(e["letter"] == "O", step(e["alone"], e["text"], e["seen"]))
        return F.struct(e["pos"].alias("pos"), made.alias("step"))

    from_linked = F.transform("_linked", emit)
    from_others = F.transform(
        F.filter(events, lambda e: e["letter"] == "N"),
        lambda e: F.struct(e["pos"].alias("pos"), step(e["alone"], e["text"], e["seen"]).alias("step")),
    )
    ends_waiting = F.when(F.size("_pieces") > 0, last_waits(F.try_element_at("_pieces", F.lit(-1)))).otherwise(False)
    last = F.try_element_at("_linked", F.lit(-1))
    trailing = F.array(F.struct(F.lit(END).alias("pos"), F.when(ends_waiting, unanswered(last)).alias("step")))
    emitted = F.filter(F.concat(from_linked, from_others, trailing), lambda x: x["step"].isNotNull())
    # Positions are unique, so sorting by position alone is a total order. Every pass over the steps copies them,
    # so they are numbered while still beside their positions.
    ordered = F.array_sort(emitted, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return known.withColumn(result, numbered(ordered, lambda x: x["step"])).drop("_linked", "_pieces", "_waiting")


def _history(record: Column) -> Column:
    """The event list: the record itself if it is a list, else ``history`` or ``events``. Only the first
    elements are looked at to tell them apart, as a record may be large."""
    paths = ("$", "$.history", "$.events")
    case = F.when(j.child(record, "$[0]").isNotNull(), _events(record, "$"))
    for path in paths[1:]:
        case = case.when(j.child(record, f"{path}[0]").isNotNull(), _events(record, path))
    return F.coalesce(case, F.array().cast(f"array<{_MEMBERS_TYPE}>"))


def _events(record: Column, path: str) -> Column:
    """The members of every event of a list; an element that is no object has none."""
    return F.coalesce(
        F.try_variant_get(record, path, f"array<{_MEMBERS_TYPE}>"), F.array().cast(f"array<{_MEMBERS_TYPE}>"))


def _boolean(value: Column) -> Column:
    return F.when(value.isNotNull() & (j.kind(value) != "VOID"), j.truthy(value))


def normalize_histories(
    records: DataFrame, keep_unnumbered_id: Column | None = None, strict_null: bool = False,
    extra_types: dict[str, str] | None = None,
) -> DataFrame:
    """Runs from records ``record VARIANT`` of the event-history format.

    ``strict_null`` is the batch rule: a null ``resolved`` falls back to the test block, and only a known
    outcome makes a test result. Without it the presence of the key alone makes one.
    """
    r = F.col("record")
    rows = pair_events(with_events(records, _history(r), plain_event, extra_types))
    top, block = j.child(r, "$.resolved"), j.child(r, "$.test_result.resolved")
    unknown = F.lit("unknown") if keep_unnumbered_id is None else keep_unnumbered_id
    instance_id = F.coalesce(
        j.first_truthy_text(j.child(r, "$.instance_id")), j.text_of(r, "$.instance.instance_id"), unknown
    )
    if strict_null:
        resolved = F.coalesce(_boolean(top), _boolean(block))
        has_result = resolved.isNotNull()
    else:
        resolved = F.when(top.isNotNull(), _boolean(top)).otherwise(_boolean(block))
        has_result = top.isNotNull() | block.isNotNull()
    test = F.when(has_result, _test_result(F.coalesce(resolved, F.lit(False))))
    return to_runs(
        rows,
        run_id=F.concat(F.lit(f"{AGENT}-"), instance_id), agent=F.lit(AGENT), model=j.text_of(r, "$.model"),
        task=task(
            instance_id, "swe-bench", j.text_of(r, "$.instance.repo"),
            j.text_of(r, "$.instance.base_commit") if strict_null else F.lit(None).cast("string"),
            F.coalesce(j.text_of(r, "$.instance.problem_statement"), F.lit("")),
        ),
        steps=F.col("steps"),
        final_patch=j.first_truthy_text(j.child(r, "$.git_patch"), j.child(r, "$.test_result.git_patch")),
        test_result=test, resolved=resolved, metadata=F.create_map().cast("map<string,string>"),
    )


def _test_result(passed: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        passed.alias("passed"), none.alias("total_tests"), none.alias("passed_tests"),
        none.alias("failed_tests"), none.alias("error_tests"), F.lit("").alias("raw_log"),
    )


def normalize_sdk(records: DataFrame, extra_types: dict[str, str] | None = None) -> DataFrame:
    """Runs from records ``record VARIANT, file_stem STRING``, one per trace file."""
    r = F.col("record")
    rows = pair_events(with_events(records, _events(r, "$.events"), sdk_event, extra_types))
    instance_id = F.coalesce(j.text_of(r, "$.instance_id"), F.col("file_stem"))
    return to_runs(
        rows,
        run_id=F.coalesce(j.first_truthy_text(j.child(r, "$.run_id")), F.concat(F.lit("sdk-"), instance_id)),
        agent=F.lit(AGENT), model=j.text_of(r, "$.model"),
        task=task(
            instance_id, "swe-bench", j.text_of(r, "$.repo"), F.lit(None).cast("string"),
            F.coalesce(j.text_of(r, "$.problem_statement"), F.lit("")),
        ),
        steps=F.col("steps"), resolved=_boolean(j.child(r, "$.resolved")),
        metadata=F.create_map().cast("map<string,string>"),
    )

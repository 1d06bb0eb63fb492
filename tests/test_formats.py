import json
import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.operators import evaluation, event_pairing, transcript_lines
from faultline.operators.normalize_actions import normalize_action_lists
from faultline.operators.normalize_chats import normalize_chats
from faultline.operators.normalize_history import normalize_histories, plain_event
from faultline.operators.normalize_sessions import normalize_sessions
from faultline.plans.queries import QUERIES
from faultline.sources import json_arrays, records, sinks
from tests.runs import CASES, run


def _records(spark, docs):
    texts = [(json.dumps(d),) for d in docs]
    return spark.createDataFrame(texts, "t STRING").select(j.parse_strict(F.col("t")).alias("record"))


def _steps(runs):
    return {r.run_id: [(s["index"], s.action_type, s.content, s.observation and (s.observation.content, s.observation.exit_code)) for s in r.steps] for r in runs.collect()}


TYPES = {"run": "command", "edit": "file_edit", "finish": "finish"}


def _expected_pairs(history):
    """Plain fold over the events."""
    out, waiting = [], None

    def name(e):
        return TYPES.get(e.get("action") or "", "unknown")

    def seen(e):
        text = e["content"]
        return (text, e.get("exit_code")) if text or e.get("exit_code") is not None else None

    def text(e):
        return e["content"] if e["content"].strip() else ""

    for e in history:
        acts = "action" in e or e.get("source") == "agent"
        observes = "observation" in e or e.get("source") == "environment"
        if observes and waiting is not None:
            out.append((name(waiting), text(waiting), seen(e)))
            waiting = None
        elif acts:
            if waiting is not None:
                out.append((name(waiting), text(waiting), None))
            waiting = e
        else:
            out.append((TYPES.get(e.get("observation") or "", "unknown"), text(e), seen(e)))
    if waiting is not None:
        out.append((name(waiting), text(waiting), None))
    return [(i, *s) for i, s in enumerate(out)]


def test_pairing_equals_a_plain_fold(spark):
    rng = random.Random(7)
    docs = []
    for n in range(120):
        history = []
        for i in range(rng.randrange(0, 14)):
            e = {"content": rng.choice(["", "  ", f"text {i}"])}
            if rng.random() < 0.5:
                e["action"] = rng.choice(["run", "edit", "finish", None])
            if rng.random() < 0.4:
                e["observation"] = rng.choice(["run", "", None])
            if rng.random() < 0.5:
                e["source"] = rng.choice(["agent", "environment", "user"])
            if rng.random() < 0.3:
                e["exit_code"] = rng.choice([0, 1])
            history.append(e)
        docs.append({"instance_id": str(n), "history": history})
    found = _steps(normalize_histories(_records(spark, docs)))
    for d in docs:
        assert found["openhands-" + d["instance_id"]] == _expected_pairs(d["history"]), d


def test_parallel_actions_keep_the_documented_order(spark):
    history = [
        {"action": "run", "command": "a", "source": "agent"}, {"action": "run", "command": "b", "source": "agent"},
        {"observation": "run", "content": "1", "source": "environment"}, {"observation": "run", "content": "2", "source": "environment"},
    ]
    steps = _steps(normalize_histories(_records(spark, [{"instance_id": "x", "history": history}])))["openhands-x"]
    assert [(s[2], s[3]) for s in steps] == [("a", None), ("b", ("1", None)), ("2", ("2", None))]


def test_event_text_and_exit_code(spark):
    history = [
        {"action": "run", "args": {"command": "ls", "n": 1}},
        {"observation": "run", "content": "x", "exit_code": 1, "extras": {"exit_code": "7"}},
        {"action": "read", "args": {"path": "", "b": [1, "a,b"]}}, {"observation": None, "content": ""},
        {"action": "write", "message": 5, "path": "p.py"}, {"observation": "o", "output": "done", "exit_code": "x"},
    ]
    steps = _steps(normalize_histories(_records(spark, [{"instance_id": "x", "events": history}])))["openhands-x"]
    assert steps == [
        (0, "command", "ls", ("x", 7)), (1, "file_read", '{"b": [1, "a,b"], "path": ""}', None),
        (2, "file_edit", "p.py", ("done", None)),
    ]


def test_transcript(spark):
    chat = "intro\n> open a.py\nApplied edit to a.py\n>   \nlost\n> run tests\r\nError: no\n\n> git commit -m x\nfine"
    runs = normalize_sessions(_records(spark, [{"instance_id": "1", "chat_history": chat, "files_edited": ["a.py"]}]))
    assert _steps(runs)["aider-1"] == [
        (0, "file_edit", "open a.py", ("Applied edit to a.py", 0)), (1, "command", "run tests", ("Error: no", 1)),
        (2, "finish", "git commit -m x", ("fine", 0)),
    ]
    assert runs.first().resolved is True


@pytest.mark.parametrize("split, rows", [(64, 3), (1 << 27, 4096)])
def test_transcript_lines_equal_whole_transcripts(spark, tmp_path, split, rows):
    dice = random.Random(6)
    lines = ["> open a.py", "> ", ">  run\x0bmore", "Applied edit to a.py", "Error: no", "", "text", "> git commit -m x", ">none", "Updated `x`"]
    chats = {"hot": dice.choices(lines, k=900), "none": ["text", ""], "one": ["> go"], **{f"t{i}": dice.choices(lines, k=9) for i in range(9)}}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, held in chats.items():
        (folder / f"{name}.md").write_text(dice.choice(["\n", "\r\n"]).join(held), encoding="utf-8", newline="")
    docs = [{"instance_id": k, "chat_history": "\n".join(v)} for k, v in chats.items()]
    whole = _steps(normalize_sessions(_records(spark, docs)))
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 1)):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        table = transcript_lines.read_transcript_lines(spark, str(folder), chunk_bits=rows.bit_length() - 1)
        steps = event_pairing.step_rows(transcript_lines.transcript_line_steps(table, rows)).collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    found = {}
    for r in sorted(steps, key=lambda r: (r.run_id, r["index"])):
        found.setdefault(r.run_id, []).append((r["index"], r.action_type, r.content, (r.obs_content, r.exit_code) if r.has_obs else None))
    assert found == {k: v for k, v in whole.items() if v} and len(found["aider-hot"]) > 200


def test_session_summary(spark):
    docs = [
        {"instance_id": "1", "files_edited": ["m.py"], "commits": [{"message": "fix"}], "error": None, "exit_status": 0, "model": "g"},
        {"task_id": "2", "files_edited": [], "error": "ModuleNotFoundError: x", "exit_status": "1"},
        {"instance_id": "3", "exit_status": "soon"},
    ]
    runs = normalize_sessions(_records(spark, docs))
    steps, resolved = _steps(runs), {r.run_id: r.resolved for r in runs.collect()}
    assert resolved == {"aider-1": True, "aider-2": False}
    assert [s[1] for s in steps["aider-1"]] == ["file_edit", "finish"]
    assert steps["aider-2"] == [(0, "command", "(aider internal)", ("ModuleNotFoundError: x", 1))]


def test_chat_calls_join_their_last_answer(spark):
    def call(i, name, args):
        return {"id": i, "function": {"name": name, "arguments": args}}

    chat = [
        {"role": "tool", "tool_call_id": "b", "content": "early"},
        {"role": "assistant", "content": None, "tool_calls": [call("a", "search_code", '{"q":"x", "n":[1,2]}'), call("b", "write_patch", "oops")]},
        {"role": "tool", "tool_call_id": "a", "content": "not found"}, {"role": "tool", "tool_call_id": "b", "content": "late"},
        {"role": "assistant", "content": "thinking"}, {"role": "assistant", "content": "x", "tool_calls": [call("c", "Finish", "{}")]},
    ]
    steps = _steps(normalize_chats(_records(spark, [{"instance_id": "1", "trajectory": chat}])))["acr-1"]
    assert steps == [
        (0, "command", 'search_code({"q": "x", "n": [1, 2]})', ("not found", 1)),
        (1, "file_edit", 'write_patch({"raw": "oops"})', ("late", 0)), (2, "unknown", "thinking", None),
        (3, "finish", "Finish({})", None),
    ]


def test_spaced_json_leaves_texts_alone(spark):
    values = [{"raw": "no json, really"}, {"a": [1, "x: y, \\"], "b": {}}, ["\"q\", ", "\n,"], "a,b", 5, {}, [], [[], {"c": None}]]
    texts = [json.dumps(v, separators=s) for v in values for s in ((",", ":"), (" ,\n", "\t: "))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", j.spaced_json(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: json.dumps(values[i // 2]) for i in range(len(texts))}


def test_event_table_reads_events_once(spark):
    """What describes an event runs once an event, however often the pairing looks at it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [("r", i, json.dumps({"source": "agent", "action": "run", "command": f"c{i}"})) for i in range(20)]
    events = spark.createDataFrame(rows, "run_id STRING, pos LONG, t STRING").select(
        "run_id", "pos", j.parse_strict(counted("t")).alias("event"))
    paired = event_pairing.pair_event_table(event_pairing.event_rows(events, plain_event), 4)
    assert paired.count() == 20 and seen.value == 20


@pytest.mark.parametrize("chunk_width", [3, 4096])
def test_event_table_pairs_like_nested_histories(spark, chunk_width):
    """Random histories, one of them a third of all events, with runs of both-kind events over many chunks."""
    dice = random.Random(chunk_width)
    letters = {
        "A": {"source": "agent", "action": "run"}, "O": {"source": "environment", "observation": "run"},
        "B": {"source": "agent", "observation": "note"}, "N": {"type": "message"},
    }

    def history(size, weights):
        kinds = dice.choices("AOBN", weights, k=size)
        return [{**letters[k], "content": f"{k}{i}", "exit_code": i % 3} if k != "A" else {**letters[k], "command": f"A{i}"} for i, k in enumerate(kinds)]

    docs = [{"instance_id": str(i), "history": history(dice.randint(0, 12), (2, 2, 2, 1))} for i in range(40)]
    docs += [{"instance_id": "hot", "history": history(240, (1, 1, 6, 2))}, {"instance_id": "both", "history": history(60, (0, 0, 1, 0))}]
    nested = _steps(normalize_histories(_records(spark, docs)))
    rows = [(f"openhands-{d['instance_id']}", i, json.dumps(e)) for d in docs for i, e in enumerate(d["history"])]
    events = spark.createDataFrame(rows, "run_id STRING, pos LONG, t STRING").repartition(3).select(
        "run_id", "pos", j.parse_strict(F.col("t")).alias("event"))
    paired = event_pairing.pair_event_table(event_pairing.event_rows(events, plain_event), chunk_width)
    found = {}
    for r in sorted(event_pairing.step_rows(paired).collect(), key=lambda r: (r.run_id, r["index"])):
        found.setdefault(r.run_id, []).append((r["index"], r.action_type, r.content, (r.obs_content, r.exit_code) if r.has_obs else None))
    assert found == {k: v for k, v in nested.items() if v}


def test_raw_record_layouts(spark, tmp_path):
    one, two = {"instance_id": "1", "trajectory": []}, {"instance_id": "2", "info": {"exit_status": "exit_cost", "resolved": True}}
    (tmp_path / "lines.jsonl").write_text(json.dumps(one) + "\n\n{broken\n" + json.dumps(two) + " trailing\n" + json.dumps(two))
    (tmp_path / "array.json").write_text(json.dumps([one, two, 3], indent=1))
    (tmp_path / "pretty.json").write_text(json.dumps(two, indent=2))
    (tmp_path / "bad.json").write_text("[1, 2")

    def ids(name, layout="document"):
        return sorted(r.run_id for r in records.read_action_lists(spark, str(tmp_path / name), layout).collect())

    assert ids("lines.jsonl", "lines") == ["swe-agent-1", "swe-agent-2"]
    assert ids("array.json") == ["swe-agent-1", "swe-agent-2"]
    assert ids("pretty.json") == ["swe-agent-2"]
    assert ids("bad.json") == []
    assert not records.read_action_lists(spark, str(tmp_path / "pretty.json"), "document").first().resolved


@pytest.mark.parametrize("split", [64, 1 << 27])
def test_split_arrays_equal_whole_documents(spark, tmp_path, split):
    odd = [
        {"id": i, "text": t, "deep": [{"a": {"b": "}"}}, [], {"c": ["{", "]"]}]} for i, t in enumerate(
            ['plain', 'quote " and } brace', "back\\slash\\", '\\"}', "}}}", "", "é}ü{", "a,b: [1]"] * 4)
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    files = {
        "dense": json.dumps(odd, separators=(",", ":")), "pretty": json.dumps(odd, indent=2), "mixed": json.dumps([1, "}", *odd[:3], None, [odd[3]], 2.5, odd[4], []]),
        "none": " [ ] ", "numbers": "[1, 2, \"}{\"]", "spaces": "\n\t" + json.dumps(odd[:2]) + "\n \n",
        "cut": json.dumps(odd)[:-1], "commas": json.dumps(odd[:3]).replace("}, {", "} {"), "tail": json.dumps(odd[:2]) + " x", "twice": "[{}] [{}]",
        "string": '"[{}]"', "open": '[{"a": "}]', "extra": "[{}]}", "empty": "",
    }
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 1)):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        found = {}
        for r in json_arrays.read_array_records(spark, str(folder)).select("file", F.to_json("record").alias("t")).collect():
            found.setdefault(r.file.rsplit("/")[-1][:-5], []).append(r.t)
        whole = sorted(r[0] for r in records.read_raw_records(spark, str(folder), "document").select(F.to_json("record")).collect())
        assert sorted(t for held in found.values() for t in held) == whole
        assert {k: len(v) for k, v in found.items()} == {"dense": 32, "pretty": 32, "mixed": 4, "spaces": 2}
        if split == 64:
            assert spark.read.option("lineSep", "}").text(str(folder / "dense.json")).rdd.getNumPartitions() > 20
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("split", [40, 1 << 27])
def test_ingest_counts_on_the_way_and_names_by_line(spark, tmp_path, split):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, n in (("a", 30), ("b", 20)):
        (folder / f"{name}.jsonl").write_text("".join("\n" * (i % 3) + json.dumps({"resolved": i % 2 == 0, "model": f"{name}{i}"}) + "\n" for i in range(n)))
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 1)):
        spark.conf.set(f"spark.sql.files.{key}", value)
    try:
        counts = records.ingest_to(spark, str(folder), str(tmp_path / "out"))
        assert counts == {"total": 50, "written": 25, "skipped": 25}
        every = records.ingest_to(spark, str(folder), str(tmp_path / "every"), all_runs=True)
        assert every == {"total": 50, "written": 50, "skipped": 0}
        names = {r.model: r.run_id for r in records.read_runs(spark, str(tmp_path / "every")).collect()}
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert names == {**{f"a{i}": f"openhands-unknown-{i + 1}" for i in range(30)}, **{f"b{i}": f"openhands-unknown-{i + 31}" for i in range(20)}}
    assert records.read_runs(spark, str(tmp_path / "out")).count() == 25


def test_trace_directory_and_batch(spark, tmp_path):
    traces = tmp_path / "traces"
    traces.mkdir()
    events = [
        {"source": "agent", "thought": [{"type": "text", "text": "look"}, {"type": "tool_use"}], "action": {"kind": "ThinkAction"}},
        {"source": "environment", "observation": {"content": [{"type": "text", "text": "logged"}]}},
    ]
    (traces / "r1.jsonl").write_text(json.dumps({"events": events, "resolved": False}))
    (traces / "metadata.json").write_text("{}")
    assert _steps(records.read_sdk_traces(spark, str(traces))) == {"sdk-r1": [(0, "message", "look", None)]}

    batch = tmp_path / "output.jsonl"
    batch.write_text("\n".join(json.dumps(d) for d in [
        {"instance": {"instance_id": "a", "repo": "r"}, "resolved": None, "test_result": {"resolved": False, "git_patch": "p"}},
        {"instance_id": "b", "resolved": True}, {"instance_id": "c"},
    ]))
    kept = records.ingest_histories(spark, str(batch)).collect()
    assert [(r.run_id, r.task.repo, r.final_patch) for r in kept] == [("openhands-a", "r", "p")]
    counts = records.ingest_counts(records.ingest_histories(spark, str(batch), all_runs=True)).first()
    assert tuple(counts) == (3, 1, 2)


def test_gold_labels_are_checked(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"run_id": "1", "task_id": "t", "true_category": "OTHER"}\n')
    bad.write_text('{"run_id": "1", "task_id": "t", "true_category": "other"}\n')
    assert records.read_gold(spark, str(good)).first().labeler == "unknown"
    with pytest.raises(Exception, match="invalid category"):
        records.read_gold(spark, str(bad)).collect()


def test_labels_keep_the_order_of_files_and_lines(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    first = [{"run_id": "r", "label": f"old {i} " + "x" * 200} for i in range(400)] + [{"run_id": "s", "label": "only"}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, first)))
    (folder / "b.jsonl").write_text('{"run_id": "r", "label": "older"}\n\n{broken\n{"run_id": "r", "label": "new"}\n{"run_id": "s", "label": ["x"')
    labels = evaluation.load_labels(records.read_labels(spark, str(folder), "label"), "label", "seq")
    assert sorted(map(tuple, labels.collect())) == [("r", "NEW"), ("s", "ONLY")]


def test_cards_with_a_mistyped_field_stay(spark, tmp_path):
    path = tmp_path / "cards.jsonl"
    path.write_text('{"run_id": "a", "confidence": "high", "owner": "o"}\n{"run_id": "b", "confidence": 0.5}\n{"run_id": \n\n[1]\n')
    cards = {r.run_id: (r.confidence, r.owner) for r in records.read_cards(spark, str(path)).collect()}
    assert cards == {"a": (None, "o"), "b": (0.5, None)}


@pytest.mark.parametrize("name", ["chat_steps", "history_steps", "action_list_steps", "transcript_steps", "session_summary_steps", "sdk_steps"])
def test_no_filter_repeats_a_normalizer(name, spark, sample):
    plan = QUERIES[name](spark, sample)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter " in line]
    assert not [f for f in filters if "transform(" in f or "variant_get" in f]


@pytest.mark.parametrize("name, path, reads", [
    ("action_list_steps", "$.observation", 1), ("action_list_steps", "$.action", 1), ("chat_steps", "$.tool_calls", 1),
    ("chat_steps", "$.role", 1)])
def test_members_are_taken_out_once(name, path, reads, spark, sample):
    """However often a text is looked at, its JSON path is followed once an entry or message."""
    plan = QUERIES[name](spark, sample)._jdf.queryExecution().analyzed().toString()
    assert plan.count(f"{path},") == reads


def test_entries_that_count_as_false_show_nothing(spark):
    """A text tells whether its value counts as true, but for those that a string shares with another type."""
    false = ["", "0", "false", "[]", "{}", "0.0", None]
    trajectory = [{"action": f"edit {v}", "observation": v} for v in false]
    trajectory += [{"action": "view", "observation": v} for v in (0, 0.0, -0.0, False, [], {}, [None], 7, True)] + ["no entry", {}]
    runs = normalize_action_lists(_records(spark, [{"instance_id": "a", "trajectory": trajectory}, {"instance_id": "b", "trajectory": trajectory[:1]}]))
    steps = _steps(runs)
    assert [s[3] and s[3][0] for s in steps["swe-agent-a"]] == [None, "0", "false", "[]", "{}", "0.0", None, *[None] * 6, "[null]", "7", "true", None, None]
    assert [s[1] for s in steps["swe-agent-a"]] == ["file_edit"] * 7 + ["file_read"] * 9 + ["unknown"] * 2
    assert steps["swe-agent-b"] == [(0, "file_edit", "edit ", None)]


def test_single_documents(spark, tmp_path):
    """An indented run, and an event-history document with its outcome at the top or in the test block."""
    one = run("single", [("command", "ls", "ok", 0)], patch="diff")
    (tmp_path / "run.json").write_text(json.dumps(one, indent=2))
    read = records.read_run_document(spark, str(tmp_path / "run.json")).first()
    assert (read.run_id, read.steps[0].observation.exit_code, read.final_patch) == ("single", 0, "diff")
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(Exception):
        records.read_run_document(spark, str(tmp_path / "broken.json")).collect()

    folder = tmp_path / "histories"
    folder.mkdir()
    documents = {
        "top": {"instance_id": "1", "resolved": True, "history": [{"source": "agent", "action": "run", "command": "x"}]},
        "block": {"instance": {"instance_id": "2", "repo": "r"}, "test_result": {"resolved": False, "git_patch": "p"}},
        "bare": {"events": [{"source": "environment", "observation": "run", "content": "seen"}]},
    }
    for name, held in documents.items():
        (folder / f"{name}.json").write_text(json.dumps(held, indent=1))
    found = {r.run_id: r for r in records.read_history_document(spark, str(folder)).collect()}
    assert set(found) == {"openhands-1", "openhands-2", "openhands-unknown"}
    assert found["openhands-1"].resolved and found["openhands-1"].test_result.passed and len(found["openhands-1"].steps) == 1
    assert (found["openhands-2"].resolved, found["openhands-2"].final_patch, found["openhands-2"].test_result.passed) == (False, "p", False)
    assert found["openhands-unknown"].resolved is None and found["openhands-unknown"].test_result is None


def test_written_runs_and_gold_are_read_again(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("\n".join(json.dumps(r) for r, _, _ in CASES))
    runs = records.read_runs(spark, str(path))
    sinks.write_json_lines(runs, str(tmp_path / "again"))
    again = records.read_runs(spark, str(tmp_path / "again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, runs.collect()))
    gold = spark.createDataFrame([("a", "t", "OTHER", "me", "")], "run_id STRING, task_id STRING, true_category STRING, labeler STRING, notes STRING")
    sinks.write_json_lines(gold, str(tmp_path / "gold"))
    assert [tuple(r) for r in records.read_gold(spark, str(tmp_path / "gold")).drop("seq").collect()] == [tuple(gold.first())]

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from faultline.operators import cards as card_ops
from faultline.operators import compaction
from faultline.operators.compaction import compacted_parts, compacted_runs, run_words
from faultline.operators.responses import cited_evidence_nested, keyword_baseline
from faultline.operators.rules import apply_rules
from faultline.operators.signals import signals_from_runs, signals_from_steps
from faultline.operators.steps import failed_steps, last_steps, steps_table, with_run_facts
from faultline.plans.classify import classify_runs, match_rules_nested
from faultline.sources.records import read_runs
from tests.runs import CASES, LOOK, run


def _runs(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("\n".join(json.dumps(r) for r, _, _ in CASES) + "\n\n")
    return read_runs(spark, str(path))


def _own(runs):
    return runs.select(
        "run_id", F.col("task.task_id").alias("task_id"), "agent", "model", "final_patch",
        F.col("test_result.passed").alias("test_passed"), "error", F.col("task.repo").alias("repo"),
        F.col("task.problem_statement").alias("problem_statement"),
        *(f"test_result.{c}" for c in ("total_tests", "passed_tests", "failed_tests", "raw_log")),
    )


def test_each_rule_decides_its_run(spark, tmp_path):
    found = {r.run_id: (r.rule_id, r.rule_code) for r in match_rules_nested(_runs(spark, tmp_path)).collect()}
    assert found == {r["run_id"]: (rule, code) for r, rule, code in CASES}


def test_steps_table_and_nested_form_agree(spark, tmp_path):
    runs = _runs(spark, tmp_path)
    nested = signals_from_runs(runs)
    folded = signals_from_steps(steps_table(runs), _own(runs))
    columns = folded.columns
    assert sorted(map(str, nested.select(columns).collect())) == sorted(map(str, folded.collect()))


def test_nested_and_table_cards_agree(spark, tmp_path):
    runs = _runs(spark, tmp_path)
    answers = spark.createDataFrame(
        [("nuanced", '```json\n{"primary_category": "scoping", "confidence": "0.4", "evidence_step_indices": [1, "0", 9],'
                     ' "evidence_notes": {"1": "why"}}\n```')], "run_id STRING, text STRING")
    a = {r.run_id: r for r in classify_runs(runs, answers).collect()}
    b = {r.run_id: r for r in card_ops.classify_steps(steps_table(runs), _own(runs), answers).collect()}
    assert a == b
    card = a["nuanced"]
    assert (card.primary_category, card.confidence, card.classifier) == ("SCOPING", 0.4, "llm")
    assert [(e.step_index, e.excerpt, e.why) for e in card.evidence] == [(1, "tweak", "why"), (0, "a.py", "")]
    assert a["crash-only"].root_cause.startswith("Classification unavailable")
    assert [(e.step_index, e.excerpt) for e in a["throttled"].evidence] == [(1, "rate limit"), (2, "network")]


def test_baseline_answers_without_responses(spark, tmp_path):
    cards = {r.run_id: r for r in classify_runs(_runs(spark, tmp_path)).collect()}
    assert cards["nuanced"].confidence == 0.55 and cards["nuanced"].provider == "mock"
    assert cards["stalled"].classifier == "rule"
    assert all(c.fix_suggestion for c in cards.values())


def test_baseline_reaches_every_code_in_both_forms(spark, tmp_path):
    words = {
        "ENVIRONMENT": "ImportError: x", "INFRA_ERROR": "code 503", "RESOURCE_LIMIT": "Timeout", "TOOL_USE": "Edit failed",
        "VERIFICATION": "premature", "CONTEXT_RETRIEVAL": "Could not find it", "REASONING": "wrong sign", "SCOPING": "unclear", "OTHER": "",
    }
    path = tmp_path / "baseline.jsonl"
    path.write_text("\n".join(json.dumps(run(code, [("message", "look at it"), ("message", word)])) for code, word in words.items()))
    runs = read_runs(spark, str(path))
    nested = {r.run_id: r.primary_category for r in classify_runs(runs, use_rules=False).collect()}
    folded = {r.run_id: r.primary_category for r in keyword_baseline(run_words(steps_table(runs), _own(runs))).collect()}
    assert nested == folded == {code: code for code in words}


def _joined(parts):
    whole = {}
    for r in sorted(parts, key=lambda r: (r.run_id, r.part)):
        whole.setdefault(r.run_id, []).append((r.part, r.text))
    assert all([n for n, _ in p] == list(range(len(p))) for p in whole.values())
    return {k: "".join(t for _, t in p) for k, p in whole.items()}


@pytest.mark.parametrize("part_steps, chunk_rows", [(256, 16_384), (3, 5), (1, 1)])
def test_compacted_parts_join_to_the_nested_text(spark, tmp_path, monkeypatch, part_steps, chunk_rows):
    monkeypatch.setattr(compaction, "PART_STEPS", part_steps)
    noisy = [("command", f'run "{i % 4}" \t\u00e9', "bash: python: command not found" if i % 3 else "ok", i % 3) for i in range(40)]
    noisy += [("file_edit", f"edit src/m{i}.py", "ok", 0) for i in range(9)] + [LOOK] * 5 + [("file_edit", "no name", "x" * 900, 1)]
    documents = [r for r, _, _ in CASES] + [run("noisy", noisy, patch="diff\n+" + "y" * 3000), run("empty", [], passed=None)]
    documents[-2]["test_result"] = {"passed": False, "total_tests": 7, "failed_tests": 2, "raw_log": "line\n" * 300}
    path = tmp_path / "texts.jsonl"
    path.write_text("\n".join(map(json.dumps, documents)))
    runs = read_runs(spark, str(path))
    whole = {r.run_id: r.text for r in compacted_runs(runs).collect()}
    assert _joined(compacted_parts(steps_table(runs), _own(runs), chunk_rows).collect()) == whole
    assert "... [4 step(s) omitted] ..." in whole["stalled"]
    assert "passed=False total=7 passed_tests=None failed_tests=2\nline" in whole["noisy"] and "TEST RESULT" not in whole["empty"]


def test_run_and_step_predicates(spark, tmp_path):
    runs = with_run_facts(_runs(spark, tmp_path))
    facts = {r.run_id: r for r in runs.select(
        "run_id", "step_count", "produced_patch", "failed", "content_hash",
        F.size(failed_steps()).alias("bad"), last_steps(F.col("steps"), 3).alias("tail")).collect()}
    assert facts["stalled"].step_count == 12 and not facts["stalled"].produced_patch and facts["stalled"].failed
    assert [s["index"] for s in facts["stalled"].tail] == [9, 10, 11]
    assert facts["crash-only"].bad == 0  # an error without an observation is not a failed step
    assert facts["throttled"].bad == 2
    assert len({f.content_hash for f in facts.values()}) == len(facts)


def test_partitioning_does_not_change_signals(spark, tmp_path):
    runs = _runs(spark, tmp_path)
    steps = steps_table(runs)
    one = apply_rules(signals_from_steps(steps, _own(runs))).select("run_id", "rule_id", "step_count").collect()
    many = apply_rules(signals_from_steps(steps.repartition(7, F.rand(3)), _own(runs))).select("run_id", "rule_id", "step_count").collect()
    assert sorted(one) == sorted(many)


def test_markdown_and_corrections(spark, tmp_path):
    cards = classify_runs(_runs(spark, tmp_path))
    corrections = spark.createDataFrame(
        [("stalled", "x", "OTHER", "n1", 1.0), ("stalled", "x", "SCOPING", "n2", 2.0)],
        "run_id STRING, auto_label STRING, true_label STRING, note STRING, created_at DOUBLE")
    text = card_ops.with_corrections(cards, corrections).filter("run_id = 'stalled'").select(card_ops.markdown().alias("m")).first().m
    assert "- **Human correction**: `SCOPING` — n2" in text and "- **Confidence**: 72%" in text


def test_nested_citations_are_linear(spark):
    dice = random.Random(5)
    steps = [(dice.randrange(300), f"content {i}") for i in range(400)]
    cited = [dice.randrange(330) for _ in range(500)]
    notes = {**{str(i): f"note {i}" for i in range(0, 330, 3)}, "007": "no index", "x": "no number"}
    last = dict(steps)
    many = 20_000

    def quoted(steps, cited, notes):
        rows = spark.createDataFrame(
            [([{"index": i, "content": c, "observation": None} for i, c in steps], cited, json.dumps(notes))],
            "steps ARRAY<STRUCT<index: INT, content: STRING, observation: STRUCT<content: STRING>>>, cited ARRAY<INT>, notes STRING")
        evidence = cited_evidence_nested(F.col("steps"), F.col("cited"), F.parse_json("notes"))
        return [tuple(e) for e in rows.select(evidence.alias("e")).first().e]

    assert quoted(steps, cited, notes) == [(i, last[i], notes.get(str(i), "")) for i in cited if i in last]
    start = time.perf_counter()
    found = quoted([(i, f"c{i}") for i in range(many)], list(range(many)), {str(i): f"n{i}" for i in range(many)})
    assert found == [(i, f"c{i}", f"n{i}") for i in range(many)] and time.perf_counter() - start < 30

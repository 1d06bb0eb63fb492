"""Nested runs to cards, row by row.

Without an external response table the whole way from runs to cards is one pass without a shuffle (but
for the ten-row taxonomy broadcast). With one, only the undecided runs are shuffled to meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.cards import (
    EVIDENCE_PER_RULE, RULE_PROVIDER, _card, evidence_from_hits, finish_cards, response_cards, rule_cards,
)
from faultline.operators.compaction import TEXT_COLUMNS, with_text
from faultline.operators.responses import (
    BASELINE_CONFIDENCE, BASELINE_KEYWORDS, baseline_cause, baseline_rank, cited_evidence_nested, read_responses,
)
from faultline.operators.rules import apply_rules
from faultline.operators.signals import signals_from_runs


def match_rules_nested(runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of nested runs with the deciding rule, its rationale and ``evidence``."""
    signals = signals_from_runs(runs, keep).withColumn("first_files", F.slice("edited_files", 1, 3))
    matched = apply_rules(signals, rationale=True)
    same = F.filter("error_fingerprints", lambda f: f["code"] == F.col("rule_code"))
    hits = F.transform(
        F.slice(same, 1, EVIDENCE_PER_RULE), lambda f: F.struct(f["step"].alias("step_index"), f["label"].alias("label"))
    )
    return matched.withColumn("evidence", evidence_from_hits(hits))


def classify_runs(
    runs: DataFrame, responses: DataFrame | None = None, use_rules: bool = True, provider: str = "offline",
    created_at: Column | None = None,
) -> DataFrame:
    """Cards of nested runs. Without ``responses`` the keyword baseline answers for the undecided runs."""
    matched = match_rules_nested(runs, TEXT_COLUMNS)
    if not use_rules:
        matched = matched.withColumn("rule_id", F.lit(None).cast("string"))
    if responses is None:
        return finish_cards(_with_baseline(matched), created_at)
    undecided = matched.filter(F.col("rule_id").isNull()).select("run_id", "task_id", "agent", "model", "steps")
    grounded = undecided.select("run_id", "steps").join(read_responses(responses), "run_id").withColumn(
        "evidence", cited_evidence_nested(F.col("steps"), F.col("cited"), F.col("notes"))
    )
    cards = response_cards(undecided, grounded.drop("steps"), provider)
    if use_rules:
        cards = rule_cards(matched).unionByName(cards)
    return finish_cards(cards, created_at)


def _with_baseline(matched: DataFrame) -> DataFrame:
    """Rule cards and baseline cards in one pass over the rows."""
    by_rule = F.col("rule_id").isNotNull()
    texts = with_text(matched, wanted=~by_rule, derived=False)
    ranked = texts.withColumn("_rank", baseline_rank(F.col("text")))
    codes = F.array(*[F.lit(code) for code, _ in BASELINE_KEYWORDS])
    guessed = ranked.withColumn("_guess", F.coalesce(F.get(codes, F.col("_rank")), F.lit("OTHER")))
    first_step = cited_evidence_nested(F.col("steps"), F.array(F.lit(0)), F.parse_json(F.lit("{}")))
    return _card(
        guessed,
        primary_category=F.when(by_rule, F.col("rule_code")).otherwise(F.col("_guess")),
        confidence=F.when(by_rule, F.col("rule_confidence")).otherwise(BASELINE_CONFIDENCE),
        classifier=F.when(by_rule, "rule").otherwise("llm"),
        root_cause=F.when(by_rule, F.col("rule_rationale")).otherwise(baseline_cause(F.col("_guess"))),
        evidence=F.when(by_rule, F.col("evidence")).otherwise(first_step),
        provider=F.when(by_rule, RULE_PROVIDER).otherwise("mock"),
    )

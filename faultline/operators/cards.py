"""Verdict cards: one row per run with category, owner, evidence and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import strip
from faultline.operators.responses import cited_evidence, read_responses
from faultline.operators.rules import apply_rules
from faultline.operators.signals import first_edited_files, first_fingerprints, signals_from_steps
from faultline.schema import CARD_DDL, CATEGORY_SCORE, EVIDENCE, struct
from faultline.taxonomy import TAXONOMY_VERSION, with_taxonomy

EVIDENCE_PER_RULE = 3
RULE_PROVIDER = "rule-based"

_ADVICE = ("owner", "recommended_action", "prevention", "fix_suggestion")


def _no_evidence() -> Column:
    return F.array().cast(f"array<{EVIDENCE}>")


def evidence_from_hits(hits: Column) -> Column:
    """Fingerprint hits (``step_index, label``) as evidence."""
    shown = F.transform(
        hits,
        lambda h: F.struct(
            h["step_index"].cast("int").alias("step_index"), h["label"].alias("excerpt"),
            F.lit("deterministic fingerprint").alias("why"),
        ),
    )
    return F.coalesce(shown.cast(f"array<{EVIDENCE}>"), _no_evidence())


def match_rules(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Signals with the deciding rule, its rationale and ``evidence``, for a steps table."""
    signals = signals_from_steps(steps, runs).join(first_edited_files(steps), "run_id", "left")
    matched = apply_rules(signals, rationale=True)
    hits = first_fingerprints(steps, EVIDENCE_PER_RULE).withColumnRenamed("code", "rule_code")
    return matched.join(hits, ["run_id", "rule_code"], "left").withColumn("evidence", evidence_from_hits(F.col("hits")))


def rule_cards(matched: DataFrame) -> DataFrame:
    """Cards of the runs a rule decides."""
    decided = matched.filter(F.col("rule_id").isNotNull())
    return _card(
        decided,
        primary_category=F.col("rule_code"), confidence=F.col("rule_confidence"), classifier=F.lit("rule"),
        root_cause=F.col("rule_rationale"), evidence=F.col("evidence"), provider=F.lit(RULE_PROVIDER),
    )


def response_cards(undecided: DataFrame, verdicts: DataFrame, provider: str) -> DataFrame:
    """Cards of the remaining runs: a parsed verdict with its evidence, else the fallback card.

    ``verdicts`` holds the columns of ``read_responses`` and ``evidence``.
    """
    both = undecided.select("run_id", "task_id", "agent", "model").join(
        verdicts.select("run_id", *_VERDICT), "run_id", "left"
    )
    return _card(both, **_answer(provider))


_VERDICT = (
    "parsed", "primary_category", "secondary_category", "confidence", "all_categories", "root_cause", "evidence"
)


def _answer(provider: str) -> dict[str, Column]:
    """The card fields a verdict gives; without a readable one those of the fallback card."""
    ok = F.coalesce("parsed", F.lit(False))
    reason = F.when(F.col("parsed").isNull(), F.lit("no response")).otherwise(F.lit("No JSON object found in model response"))
    return {
        "primary_category": F.when(ok, F.col("primary_category")).otherwise("OTHER"),
        "secondary_category": F.when(ok, F.col("secondary_category")),
        "confidence": F.when(ok, F.col("confidence")).otherwise(0.0),
        "classifier": F.lit("llm"),
        "all_categories": F.when(ok, F.col("all_categories")),
        "root_cause": F.when(ok, F.col("root_cause")).otherwise(
            F.concat(F.lit("Classification unavailable: Provider error: "), reason)
        ),
        "evidence": F.when(ok, F.col("evidence")),
        "provider": F.lit(provider),
    }


def _card(rows: DataFrame, **values: Column) -> DataFrame:
    fields = {
        "secondary_category": F.lit(None).cast("string"),
        "all_categories": F.lit(None),
        "human_label": F.lit(None).cast("string"),
        "human_note": F.lit(None).cast("string"),
        **values,
    }
    fields["evidence"] = F.coalesce(fields["evidence"], _no_evidence())
    fields["all_categories"] = F.coalesce(
        fields["all_categories"].cast(f"array<{CATEGORY_SCORE}>"), F.array().cast(f"array<{CATEGORY_SCORE}>")
    )
    own = [F.col(c) for c in ("run_id", "task_id", "agent", "model")]
    return rows.select(*own, *[c.alias(n) for n, c in fields.items()])


def finish_cards(cards: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Look owner and advice up and put the columns in order. ``created_at`` is left out unless given,
    so that the result depends on the input alone."""
    full = with_taxonomy(cards, "primary_category", *_ADVICE).withColumn("taxonomy_version", F.lit(TAXONOMY_VERSION))
    if created_at is not None:
        full = full.withColumn("created_at", created_at)
    order = [f for f in struct(CARD_DDL).fieldNames() if f in full.columns]
    return full.select(*order)


def classify_steps(
    steps: DataFrame, runs: DataFrame, responses: DataFrame | None = None, use_rules: bool = True,
    provider: str = "offline", created_at: Column | None = None,
) -> DataFrame:
    """Cards for a steps table: rule cards, response cards and fallback cards in one frame."""
    if responses is None:
        responses = steps.sparkSession.sql("SELECT '' AS run_id, '' AS text WHERE false")
    verdicts = read_responses(responses)
    verdicts = verdicts.join(cited_evidence(verdicts, steps), "run_id", "left")
    if not use_rules:
        return finish_cards(response_cards(runs, verdicts, provider), created_at)
    return finish_cards(_merged_cards(match_rules(steps, runs), verdicts, provider), created_at)


def _merged_cards(matched: DataFrame, verdicts: DataFrame, provider: str) -> DataFrame:
    """Rule cards and response cards from one join with one row per run on either side, so that the
    steps behind ``matched`` are read for both at once."""
    ruled = matched.select(
        "run_id", "task_id", "agent", "model", F.col("rule_id").isNotNull().alias("_by_rule"), "rule_code",
        "rule_confidence", "rule_rationale", F.col("evidence").alias("_rule_evidence"),
    )
    both = ruled.join(verdicts.select("run_id", *_VERDICT), "run_id", "left")
    by_rule, answer = F.col("_by_rule"), _answer(provider)
    rule = {
        "primary_category": F.col("rule_code"), "confidence": F.col("rule_confidence"), "classifier": F.lit("rule"),
        "root_cause": F.col("rule_rationale"), "evidence": F.col("_rule_evidence"), "provider": F.lit(RULE_PROVIDER),
    }
    return _card(both, **{n: F.when(by_rule, rule.get(n)).otherwise(c) if n in rule else F.when(~by_rule, c) for n, c in answer.items()})


def with_corrections(cards: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overlay the latest human correction of each run."""
    latest = corrections.groupBy("run_id").agg(
        F.max_by("true_label", "created_at").alias("_label"), F.max_by("note", "created_at").alias("_note")
    )
    return (
        cards.drop("human_label", "human_note")
        .join(latest, "run_id", "left")
        .withColumnsRenamed({"_label": "human_label", "_note": "human_note"})
    )


def percent(value: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(value * 100, 0))


def markdown(created_at: Column | None = None) -> Column:
    """The card as a Markdown note; its headings are fixed values."""
    c = F.col
    model = F.when(F.length("model") > 0, F.concat(F.lit("  ·  **Model**: "), c("model"))).otherwise("")
    scores = F.array_join(
        F.transform("all_categories", lambda s: F.concat(F.lit("`"), s["category"], F.lit("` ("), percent(s["confidence"]), F.lit(")"))),
        ", ",
    )
    note = F.when(F.length("human_note") > 0, F.concat(F.lit(" — "), c("human_note"))).otherwise("")
    evidence = F.array_join(
        F.transform(
            "evidence",
            lambda e: F.concat(
                F.lit("- **step "), e["step_index"].cast("string"), F.lit("**: `"),
                F.substring(strip(e["excerpt"]), 1, 200), F.lit("`"),
                F.when(F.length(e["why"]) > 0, F.concat(F.lit("\n  - "), e["why"])).otherwise(""),
            ),
        ),
        "\n",
    )
    stamp = F.concat(F.lit(" · "), created_at) if created_at is not None else F.lit("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Triage: "), c("task_id"), F.lit("  ·  `"), c("primary_category"), F.lit("`")),
        F.lit(""),
        F.concat(F.lit("- **Run**: `"), c("run_id"), F.lit("`  ·  **Agent**: "), c("agent"), model),
        F.concat(F.lit("- **Confidence**: "), percent(c("confidence")), F.lit("  ·  **Classifier**: "), c("classifier")),
        F.concat(F.lit("- **Owner**: `"), c("owner"), F.lit("`")),
        F.when(F.length("secondary_category") > 0, F.concat(F.lit("- **Secondary**: `"), c("secondary_category"), F.lit("`"))),
        F.when(F.size("all_categories") > 0, F.concat(F.lit("- **All categories**: "), scores)),
        F.when(F.length("human_label") > 0, F.concat(F.lit("- **Human correction**: `"), c("human_label"), F.lit("`"), note)),
        F.lit("\n## Root cause"), c("root_cause"),
        F.lit("\n## Evidence"),
        F.when(F.size("evidence") > 0, evidence).otherwise("- _No specific step evidence captured._"),
        F.lit("\n## Recommended action"), c("recommended_action"),
        F.lit("\n## Prevention (class-level)"), c("prevention"), F.lit(""),
        F.concat(F.lit("_taxonomy "), c("taxonomy_version"), F.lit(" · "), c("provider"), stamp, F.lit("_")),
    )


def search(
    cards: DataFrame, category: str | None = None, owner: str | None = None, min_confidence: float = 0.0,
    text: str = "",
) -> DataFrame:
    """Cards by category, owner, confidence and a case-insensitive word in task, run or root cause."""
    kept = cards.filter(F.col("confidence") >= min_confidence)
    if category:
        kept = kept.filter(F.col("primary_category") == category)
    if owner:
        kept = kept.filter(F.col("owner") == owner)
    if text:
        needle = text.lower().strip()
        kept = kept.filter(
            F.lower("task_id").contains(needle) | F.lower("run_id").contains(needle)
            | F.lower("root_cause").contains(needle)
        )
    return kept

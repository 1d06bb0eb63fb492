"""From a table of model responses to verdicts.

No model is called here: ``responses(run_id, text)`` is an input table, and this module repairs the
JSON, normalizes the codes and grounds the cited steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.arrays import group_starts, groups, let
from faultline.functions.barrier import computed_once
from faultline.functions.text import contains_any, strip
from faultline.schema import CATEGORY_SCORE, EVIDENCE
from faultline.taxonomy import is_code

MIN_SCORE = 0.2
DEFAULT_CONFIDENCE = 0.5
EXCERPT_CHARS = 200

# The keyword baseline, in order; the first list with a hit decides.
BASELINE_CONFIDENCE = 0.55
BASELINE_KEYWORDS = [
    ("ENVIRONMENT", ["modulenotfound", "importerror", "pip install", "no module named"]),
    ("INFRA_ERROR", ["rate limit", "429", "503", "connection reset", "traceback"]),
    ("RESOURCE_LIMIT", ["max iterations", "context window", "token limit", "timeout"]),
    ("TOOL_USE", ["patch does not apply", "edit failed", "malformed"]),
    ("VERIFICATION", ["finish", "did not run tests", "premature"]),
    ("CONTEXT_RETRIEVAL", ["could not find", "no such file", "grep"]),
    ("REASONING", ["assertion", "off-by-one", "wrong"]),
    ("SCOPING", ["ambiguous", "unclear", "underspecified"]),
]


def repaired_json(text: Column) -> Column:
    """The JSON object inside a model's answer: a fenced block, else the whole text, else the outermost
    braces; null when none of them parses."""
    text = strip(text)
    blocks = F.transform(
        F.when(text.contains("```"), F.split(text, "```")).otherwise(F.array().cast("array<string>")),
        lambda b: strip(F.regexp_replace(b, r"(?U)^\s*json", "")),
    )
    fenced = F.filter(
        F.transform(F.filter(blocks, lambda b: b.startswith("{")), j.parse_strict), lambda v: v.isNotNull()
    )
    whole = j.parse_strict(text)
    outermost = j.parse_strict(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    found = F.coalesce(F.get(fenced, 0), whole, outermost)
    return F.when(j.is_object(found), found)


def _code(value: Column) -> Column:
    return F.upper(strip(j.text_of(value)))


def _score(value: Column, default: float) -> Column:
    """A number from a JSON number, boolean or numeric text; ``default`` otherwise; within [0, 1]."""
    shape = j.kind(value)
    number = F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(
        j.text_of(value).try_cast("double")
    )
    return F.least(F.greatest(F.coalesce(number, F.lit(default)), F.lit(0.0)), F.lit(1.0))


def read_responses(responses: DataFrame) -> DataFrame:
    """Add the parsed verdict to each response. ``parsed`` is false where no JSON could be found."""
    raw = F.col("raw")
    primary, secondary = _code(j.child(raw, "$.primary_category")), _code(j.child(raw, "$.secondary_category"))
    scores = F.transform(
        j.array_at(raw, "$.all_categories"),
        lambda e: F.struct(
            _code(j.child(e, "$.category")).alias("category"),
            F.when(
                j.has_key(e, "confidence"),
                F.when(
                    j.kind(j.child(e, "$.confidence")) == "BOOLEAN",
                    F.try_variant_get(e, "$.confidence", "boolean").cast("double"),
                ).otherwise(j.text_of(e, "$.confidence").try_cast("double")),
            ).otherwise(0.0).alias("confidence"),
            F.lit("llm").alias("source"),
        ),
    )
    kept = F.filter(scores, lambda s: is_code(s["category"]) & F.coalesce(s["confidence"] >= MIN_SCORE, F.lit(False)))
    root = j.child(raw, "$.root_cause")
    cause = F.when(root.isNull(), F.lit("")).otherwise(F.coalesce(j.text_of(root), F.lit("None")))
    cited = F.filter(
        F.transform(j.array_at(raw, "$.evidence_step_indices"), j.integer_of), lambda i: i.isNotNull()
    )
    return computed_once(responses, raw=repaired_json(F.col("text"))).select(
        "run_id",
        raw.isNotNull().alias("parsed"),
        F.when(is_code(primary), primary).otherwise("OTHER").alias("primary_category"),
        F.when(is_code(secondary), secondary).alias("secondary_category"),
        _score(j.child(raw, "$.confidence"), DEFAULT_CONFIDENCE).alias("confidence"),
        F.coalesce(kept, F.array()).cast(f"array<{CATEGORY_SCORE}>").alias("all_categories"),
        F.coalesce(F.nullif(strip(cause), F.lit("")), F.lit("(no root cause given)")).alias("root_cause"),
        cited.alias("cited"),
        j.child(raw, "$.evidence_notes").alias("notes"),
    )


def _note(notes: Column, index: Column) -> Column:
    by_index = F.try_variant_get(notes, "$", "map<string,string>")
    return F.coalesce(by_index[index.cast("string")], F.lit(""))


def excerpt(content: Column, observation: Column) -> Column:
    return F.coalesce(
        F.nullif(F.substring(content, 1, EXCERPT_CHARS), F.lit("")),
        F.substring(observation, 1, EXCERPT_CHARS),
        F.lit(""),
    )


def cited_evidence(verdicts: DataFrame, steps: DataFrame) -> DataFrame:
    """``run_id, evidence``: the cited steps that exist, in citation order.

    Citations join the steps on (run, index), so one long run spreads over many tasks; the array per
    run is as long as the citation list of its own response.
    """
    cites = verdicts.filter("parsed").select("run_id", "notes", F.posexplode("cited").alias("rank", "step_index"))
    cites = cites.select("run_id", "rank", "step_index", _note(F.col("notes"), F.col("step_index")).alias("why"))
    quoted = steps.select(
        "run_id", F.col("index").alias("step_index"), excerpt(F.col("content"), F.col("obs_content")).alias("excerpt")
    )
    found = cites.join(quoted, ["run_id", "step_index"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "step_index", "excerpt", "why")))
    return found.groupBy("run_id").agg(
        F.transform(
            ordered, lambda e: F.struct(e["step_index"].cast("int").alias("step_index"), e["excerpt"], e["why"])
        ).cast(f"array<{EVIDENCE}>").alias("evidence")
    )


def cited_evidence_nested(steps: Column, cited: Column, notes: Column) -> Column:
    """The same for a nested run: the last step with a cited index is quoted.

    Steps, notes and citations are sorted together by index, so that each citation lies beside what it needs: the
    work is that of sorting, however many citations and steps there are.
    """
    def entry(index: Column, kind: int, place: Column, note: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if note is None else note
        return F.struct(index.cast("long").alias("index"), F.lit(kind).alias("kind"), place.cast("int").alias("place"), text.alias("note"))

    named = F.map_entries(F.coalesce(F.try_variant_get(notes, "$", "map<string,string>"), F.create_map().cast("map<string,string>")))
    # A note counts under the plain digits of an index only.
    numbered = F.filter(named, lambda e: e["key"].try_cast("long").cast("string") == e["key"])
    everything = F.concat(
        F.transform(numbered, lambda e: entry(e["key"].try_cast("long"), 0, F.lit(0), e["value"])),
        F.transform(steps, lambda s, i: entry(s["index"], 1, i)), F.transform(cited, lambda i, rank: entry(i, 2, rank)))

    def answered(group: Column) -> Column:
        note = F.get(F.filter(group, lambda e: e["kind"] == 0), 0)["note"]
        last = F.try_element_at(F.filter(group, lambda e: e["kind"] == 1), F.lit(-1))["place"]
        return let(F.struct(note.alias("note"), last.alias("last")), lambda known: F.transform(
            F.filter(group, lambda e: (e["kind"] == 2) & known["last"].isNotNull()),
            lambda e: F.struct(e["place"].alias("rank"), e["index"].alias("index"), known["last"].alias("place"), known["note"].alias("note"))))

    found = let(F.array_sort(everything), lambda o: let(
        group_starts(o, lambda e: e["index"]), lambda starts: F.flatten(F.transform(groups(o, starts), answered))))

    def quote(e: Column) -> Column:
        return let(F.get(steps, e["place"]), lambda step: F.struct(
            e["index"].cast("int").alias("step_index"), excerpt(step["content"], step["observation"]["content"]).alias("excerpt"),
            F.coalesce(e["note"], F.lit("")).alias("why")))

    evidence = F.transform(F.array_sort(found), quote).cast(f"array<{EVIDENCE}>")
    return F.when(cited.isNotNull() & steps.isNotNull(), evidence)


def baseline_rank(text: Column) -> Column:
    """Position of the first keyword list with a hit in the lower-cased text, else null."""
    lowered = F.lower(text)
    case = None
    for i, (_, words) in enumerate(BASELINE_KEYWORDS):
        hit = contains_any(lowered, words)
        case = F.when(hit, F.lit(i)) if case is None else case.when(hit, F.lit(i))
    return case


def baseline_cause(code: Column) -> Column:
    return F.concat(
        F.lit("[MOCK] Deterministic offline classification based on keyword signals. Selected "), code, F.lit(".")
    )


def keyword_baseline(texts: DataFrame) -> DataFrame:
    """Keyword guess per run over the ``run_id, text`` of ``run_words``, which may hold several parts per run:
    every part is ranked by itself and the lowest rank wins."""
    ranked = texts.select("run_id", baseline_rank(F.col("text")).alias("_rank"))
    codes = F.array(*[F.lit(code) for code, _ in BASELINE_KEYWORDS])
    return ranked.groupBy("run_id").agg(F.min("_rank").alias("_rank")).select(
        "run_id",
        F.coalesce(F.get(codes, F.col("_rank")), F.lit("OTHER")).alias("primary_category"),
        F.lit(BASELINE_CONFIDENCE).alias("confidence"),
    )


def baseline_responses(texts: DataFrame) -> DataFrame:
    """The keyword guess as a response table, so it takes the same path as a model's answer."""
    guess = keyword_baseline(texts)
    body = F.struct(
        "primary_category", "confidence",
        baseline_cause(F.col("primary_category")).alias("root_cause"),
        F.array(F.lit(0)).alias("evidence_step_indices"),
    )
    return guess.select("run_id", F.to_json(body).alias("text"))

"""The registered queries: each reads the sample tables of a directory and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import calibration, cards as card_ops, compaction, evaluation, event_pairing, mining, responses as response_ops
from faultline.operators import signals as signal_ops, steps as step_ops, transcript_lines, views
from faultline.operators.normalize_actions import normalize_action_lists
from faultline.operators.normalize_chats import normalize_chats
from faultline.operators.normalize_history import normalize_histories, normalize_sdk, plain_event
from faultline.operators.normalize_sessions import normalize_sessions
from faultline.plans.classify import classify_runs
from faultline.sources import derived, derived_logs
from faultline.sources.records import ingest_counts, union_runs
from faultline.streaming.sessions import step_sessions as sessions_of
from faultline.streaming.windows import fingerprint_windows
from faultline.taxonomy import CODES, with_taxonomy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _rk(column: str = "run_id") -> Column:
    return F.substring_index(column, "-", -1).cast("long")


# ---------------------------------------------------------------------------------------------
# Inputs the sample tables do not hold


def verdict_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow card per run: the rule's verdict, or OTHER at confidence 0 where no rule decides."""
    decided = derived.decided(spark, sf_dir)
    by_rule = F.col("rule_id").isNotNull()
    narrow = decided.select(
        "run_id", "task_id", "agent", F.col("rule_code"),
        F.coalesce("rule_code", F.lit("OTHER")).alias("primary_category"),
        F.coalesce("rule_confidence", F.lit(0.0)).alias("confidence"),
        F.when(by_rule, "rule").otherwise("llm").alias("classifier"),
    )
    return with_taxonomy(narrow, "primary_category", "owner")


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response table: plain, fenced, wrapped in prose, off the taxonomy, unreadable, or missing."""
    runs = derived.runs(spark, sf_dir).select("run_id", "rk")
    rk = F.col("rk").cast("string")
    plain = F.concat(
        F.lit('{"primary_category":" scoping ","secondary_category":"verification","confidence":0.9,"root_cause":" Vague task '),
        rk, F.lit(' ","evidence_step_indices":[2,0,"1",999999,"x"],"evidence_notes":{"0":"first","2":"third"},'
                  '"all_categories":[{"category":"scoping","confidence":0.9},{"category":"OTHER","confidence":0.1},'
                  '{"category":"none","confidence":0.5},{"category":"REASONING","confidence":"0.2"}]}'),
    )
    fenced = F.lit('Sure.\n```json\n{"primary_category":"VERIFICATION","confidence":"0.7","secondary_category":"bogus",'
                   '"root_cause":"","evidence_step_indices":[1.0]}\n```\nDone.')
    prose = F.concat(F.lit('I think {"primary_category":"REASONING","confidence":1.7,"root_cause":"Logic {'), rk,
                     F.lit('}","evidence_step_indices":[]} is right'))
    foreign = F.lit('{"primary_category":"NOPE","confidence":"high","root_cause":"Unknown","evidence_step_indices":[0]}')
    kind = F.col("rk") % 6
    text = F.when(kind == 0, plain).when(kind == 1, fenced).when(kind == 2, prose).when(kind == 3, foreign).when(
        kind == 4, "I cannot tell."
    )
    return runs.withColumn("text", text).filter(kind != 5).select("run_id", "text")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows of the verdict cards against the sample gold labels."""
    cards = verdict_cards(spark, sf_dir)
    # Gold derives from the same row, so it is placed beside the card instead of joined to it again.
    rk = _rk()
    other = F.array(*[F.lit(c) for c in CODES])[(rk % 10).cast("int")]
    label = F.when((rk * 7919) % 10 < 7, F.col("primary_category")).otherwise(other)
    return cards.select(
        "run_id", "task_id", label.alias("true"), F.col("primary_category").alias("predicted"),
        (label == F.col("primary_category")).alias("correct"), "confidence", "classifier",
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the text of an unexplained failure."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("run_id"), "text"
    )


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two annotators: the quality flag, and the inverse of the toxic flag."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").cast("string").alias("run_id"), F.col("doc_id").alias("seq"), "quality", "toxic")
    first = labels.withColumn("label", F.when(F.col("quality") == 1, " good ").otherwise("bad"))
    second = labels.withColumn("label", F.when(F.col("toxic") == 0, "Good").otherwise("bad"))
    return evaluation.load_labels(first, "label", "seq"), evaluation.load_labels(second, "label", "seq")


def _step_rows(runs: DataFrame) -> DataFrame:
    return step_ops.steps_table(runs).select(
        "run_id", "index", "action_type", "content", "has_obs", "obs_content", "exit_code"
    )


# ---------------------------------------------------------------------------------------------
# Runs and steps


@query
def steps_table(spark, sf_dir):
    return derived.steps(spark, sf_dir).drop("ts")


@query
def step_failed(spark, sf_dir):
    steps = step_ops.with_step_failed(derived.steps(spark, sf_dir))
    return steps.groupBy("run_id", "action_type", "failed").agg(F.count("*").alias("n"))


@query
def failed_steps(spark, sf_dir):
    steps = step_ops.with_step_failed(derived.steps(spark, sf_dir))
    return steps.filter("failed").select("run_id", "index", "action_type", "obs_content")


@query
def last_steps(spark, sf_dir):
    return step_ops.last_step_rows(derived.steps(spark, sf_dir)).select("run_id", "index", "action_type", "content")


@query
def run_facts(spark, sf_dir):
    runs = derived.runs(spark, sf_dir)
    return runs.select(
        "run_id", F.col("n_steps").alias("step_count"),
        step_ops.produced_patch(F.col("final_patch")).alias("produced_patch"),
        step_ops.run_failed(F.col("resolved"), F.col("test_passed")).alias("failed"),
        step_ops.content_hash(
            F.col("task_id"), F.col("agent"), F.col("model"), F.col("final_patch"), F.col("n_steps")
        ).alias("content_hash"),
    )


@query
def failed_runs(spark, sf_dir):
    return run_facts(spark, sf_dir).filter("failed").select("run_id", "step_count")


@query
def unique_content(spark, sf_dir):
    return step_ops.drop_duplicate_content(run_facts(spark, sf_dir)).select("content_hash")


# ---------------------------------------------------------------------------------------------
# Signals


@query
def fingerprints(spark, sf_dir):
    return signal_ops.fingerprints(derived.steps(spark, sf_dir))


@query
def edited_files(spark, sf_dir):
    return signal_ops.edited_files(derived.steps(spark, sf_dir))


@query
def files_opened(spark, sf_dir):
    return signal_ops.opened_files(derived.steps(spark, sf_dir))


@query
def repeated_commands(spark, sf_dir):
    return signal_ops.repeated_commands(derived.steps(spark, sf_dir))


@query
def signals_wide(spark, sf_dir):
    lists = ("infra_labels", "resource_labels", "tool_labels", "early_env_labels", "late_command_labels")
    signals = derived.signals(spark, sf_dir)
    return signals.withColumns({c: F.array_join(c, ", ") for c in lists})


@query
def test_verdicts(spark, sf_dir):
    return derived.signals(spark, sf_dir).select(
        "run_id", "ran_tests", "tests_passed", "finished_explicitly", "finished_without_testing", "finished_on_red"
    )


@query
def edit_signals(spark, sf_dir):
    return derived.signals(spark, sf_dir).select(
        "run_id", "no_file_edits", "last_edit_step_index", "assertion_after_edit", "catastrophic_edit",
        "verified_without_editing", "narrow_file_search",
    )


@query
def signal_features(spark, sf_dir):
    return mining.features(derived.signals(spark, sf_dir), "run_id")


# ---------------------------------------------------------------------------------------------
# Rules and cards


@query
def rule_cascade(spark, sf_dir):
    matched = card_ops.match_rules(derived.steps(spark, sf_dir), derived.runs(spark, sf_dir))
    return matched.select("run_id", "rule_id", "rule_code", "rule_confidence", "rule_rationale")


@query
def rule_hits(spark, sf_dir):
    return derived.decided(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("count"))


def _evidence_rows(cards: DataFrame) -> DataFrame:
    return cards.select("run_id", F.posexplode("evidence").alias("rank", "e")).select(
        "run_id", "rank", F.col("e.step_index").alias("step_index"), F.col("e.excerpt").alias("excerpt"),
        F.col("e.why").alias("why"),
    )


@query
def rule_evidence(spark, sf_dir):
    matched = card_ops.match_rules(derived.steps(spark, sf_dir), derived.runs(spark, sf_dir))
    return _evidence_rows(card_ops.rule_cards(matched))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_ops.classify_steps(
        derived.steps(spark, sf_dir), derived.runs(spark, sf_dir), model_responses(spark, sf_dir)
    )


def _scores_text() -> Column:
    return F.array_join(
        F.transform("all_categories", lambda s: F.concat(s["category"], F.lit("="), F.round(s["confidence"] * 100).cast("int").cast("string"))), ","
    )


@query
def cards(spark, sf_dir):
    return _cards(spark, sf_dir).select(
        "run_id", "task_id", "agent", "model", "primary_category", "secondary_category", "confidence", "classifier",
        _scores_text().alias("all_categories"), "root_cause", F.size("evidence").alias("n_evidence"), "owner",
        "recommended_action", "prevention", "fix_suggestion", "taxonomy_version", "provider",
    )


@query
def card_evidence(spark, sf_dir):
    return _evidence_rows(_cards(spark, sf_dir))


@query
def card_markdown(spark, sf_dir):
    return _cards(spark, sf_dir).select("run_id", card_ops.markdown().alias("markdown"))


@query
def card_search(spark, sf_dir):
    found = card_ops.search(_cards(spark, sf_dir), owner="agent_framework", min_confidence=0.65, text=" STEP ")
    return found.select("run_id", "primary_category", "confidence", "root_cause")


@query
def cards_without_rules(spark, sf_dir):
    steps, runs = derived.steps(spark, sf_dir), derived.runs(spark, sf_dir)
    found = card_ops.classify_steps(steps, runs, model_responses(spark, sf_dir), use_rules=False)
    return found.select("run_id", "primary_category", "secondary_category", "confidence", "classifier", "root_cause")


@query
def response_verdicts(spark, sf_dir):
    read = response_ops.read_responses(model_responses(spark, sf_dir))
    return read.select(
        "run_id", "parsed", "primary_category", "secondary_category", "confidence",
        _scores_text().alias("all_categories"), "root_cause",
        F.array_join(F.transform("cited", lambda i: i.cast("string")), ",").alias("cited"),
    )


@query
def response_evidence(spark, sf_dir):
    read = response_ops.read_responses(model_responses(spark, sf_dir))
    return _evidence_rows(response_ops.cited_evidence(read, derived.steps(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------
# Texts


@query
def salient_steps(spark, sf_dir):
    kept = compaction.salient_steps(derived.steps(spark, sf_dir))
    return kept.select("run_id", "index", "action_type", "skipped")


@query
def compacted_parts(spark, sf_dir):
    return compaction.compacted_parts(derived.steps(spark, sf_dir), derived.runs(spark, sf_dir))


@query
def prompt_parts(spark, sf_dir):
    made = compaction.prompts(compacted_parts(spark, sf_dir))
    return made.select("run_id", "part", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query
def keyword_baseline(spark, sf_dir):
    return response_ops.keyword_baseline(compaction.run_words(derived.steps(spark, sf_dir), derived.runs(spark, sf_dir)))


# ---------------------------------------------------------------------------------------------
# Views


@query
def category_distribution(spark, sf_dir):
    return with_taxonomy(views.category_distribution(verdict_cards(spark, sf_dir)), "primary_category", "owner")


@query
def owner_distribution(spark, sf_dir):
    return views.owner_distribution(verdict_cards(spark, sf_dir))


@query
def classifier_split(spark, sf_dir):
    return views.classifier_split(verdict_cards(spark, sf_dir))


@query
def rule_rate(spark, sf_dir):
    return views.rule_rate(verdict_cards(spark, sf_dir))


@query
def other_rate(spark, sf_dir):
    return views.other_rate(verdict_cards(spark, sf_dir))


@query
def average_confidence(spark, sf_dir):
    return views.average_confidence(verdict_cards(spark, sf_dir))


@query
def calibration_view(spark, sf_dir):
    return views.calibration_view(verdict_cards(spark, sf_dir))


@query
def summary_tiles(spark, sf_dir):
    return views.summary_tiles(verdict_cards(spark, sf_dir))


@query
def zero_filled_distribution(spark, sf_dir):
    return views.zero_filled_distribution(verdict_cards(spark, sf_dir))


@query
def stored_distribution(spark, sf_dir):
    """Cards as an old export holds them: some without a category or owner."""
    rk = _rk()
    stored = verdict_cards(spark, sf_dir).select(
        F.when(rk % 11 != 0, F.col("primary_category")).alias("primary_category"),
        F.when(rk % 13 != 0, F.col("owner")).alias("owner"),
    )
    return views.stored_distribution(stored)


@query
def version_pivot(spark, sf_dir):
    """The rule verdicts against the human labels."""
    pairs = _pairs(spark, sf_dir)
    both = pairs.select(F.explode(F.array(
        F.struct(F.lit("auto").alias("version"), F.col("predicted").alias("primary_category")),
        F.struct(F.lit("manual").alias("version"), F.col("true").alias("primary_category")),
    )).alias("v")).select("v.*")
    return views.version_pivot(both, "version", ["auto", "manual"])


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per day on which runs ended."""
    ended = derived.runs(spark, sf_dir).select("run_id", F.to_date("ended_at").alias("day"))
    batches = verdict_cards(spark, sf_dir).join(ended, "run_id")
    return views.trend_row(batches, F.unix_date("day") * 86400, ["day"]).drop("day")


@query
def trend(spark, sf_dir):
    return _trend(spark, sf_dir)


@query
def trend_topk(spark, sf_dir):
    return views.latest_trend(_trend(spark, sf_dir), 7)


@query
def trend_size(spark, sf_dir):
    return views.trend_size(_trend(spark, sf_dir))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human corrections of some runs, two for every other one."""
    cards = verdict_cards(spark, sf_dir)
    rk = _rk()
    code = F.array(*[F.lit(c.lower()) for c in CODES])
    requests = cards.filter(rk % 9 == 0).select(
        "run_id", F.explode(F.when(rk % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("round"),
    ).select(
        "run_id", code[((rk + F.col("round") * 3) % 10).cast("int")].alias("true_label"),
        F.when(rk % 5 != 0, F.concat(F.lit("note "), rk.cast("string"))).alias("note"),
        (rk * 10 + F.col("round")).alias("created_at"),
    )
    return views.correction_rows(requests, cards)


@query
def corrections(spark, sf_dir):
    return _corrections(spark, sf_dir)


@query
def corrections_topk(spark, sf_dir):
    return views.latest_corrections(_corrections(spark, sf_dir), 20)


@query
def correction_overlay(spark, sf_dir):
    plain = verdict_cards(spark, sf_dir).withColumns(
        {"human_label": F.lit(None).cast("string"), "human_note": F.lit(None).cast("string")}
    )
    return card_ops.with_corrections(plain, _corrections(spark, sf_dir)).select(
        "run_id", "primary_category", "human_label", "human_note"
    )


# ---------------------------------------------------------------------------------------------
# Evaluation


@query
def eval_details(spark, sf_dir):
    """Cards joined with a gold table that holds one run in three twice; the later label wins."""
    cards = verdict_cards(spark, sf_dir)
    gold = derived.gold(derived.decided(spark, sf_dir))
    again = gold.filter(F.col("seq") % 3 == 0).withColumns(
        {"true_category": F.lit("OTHER"), "seq": F.col("seq") + 1_000_000_000}
    )
    return evaluation.details(cards, gold.unionByName(again), "seq")


@query
def eval_report(spark, sf_dir):
    return evaluation.report(_pairs(spark, sf_dir))


@query
def accuracy_kappa(spark, sf_dir):
    numbers = evaluation.agreement(_pairs(spark, sf_dir))
    return numbers.select("n", "n_agree", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query
def per_class(spark, sf_dir):
    scored = evaluation.per_class(_pairs(spark, sf_dir))
    return scored.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def confusion(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir))


@query
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_interval(_pairs(spark, sf_dir))


@query
def annotator_bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_interval(evaluation.overlap(*_labels(spark, sf_dir)), upper_shift=0)


@query
def half_split(spark, sf_dir):
    halves = evaluation.half_split(_pairs(spark, sf_dir))
    numbers = evaluation.agreement(halves, ["half"])
    return numbers.select("half", "n", "n_agree", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query
def annotator_agreement(spark, sf_dir):
    return evaluation.annotator_agreement(*_labels(spark, sf_dir))


@query
def annotator_disagreements(spark, sf_dir):
    return evaluation.disagreements(evaluation.overlap(*_labels(spark, sf_dir)))


@query
def disagreement_pairs(spark, sf_dir):
    return evaluation.disagreement_pairs(_pairs(spark, sf_dir))


@query
def label_queue(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("run_id"), "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("run_id"))
    return evaluation.label_queue(docs, labels, 10)


# ---------------------------------------------------------------------------------------------
# Calibration


@query
def reliability_bins(spark, sf_dir):
    return calibration.reliability(_pairs(spark, sf_dir)).withColumn("gap", F.round("gap", 4))


@query
def ece_mce(spark, sf_dir):
    return calibration.calibration_error(_pairs(spark, sf_dir))


@query
def platt_fit(spark, sf_dir):
    fitted = calibration.fit_platt(_pairs(spark, sf_dir))
    return fitted.select("n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query
def calibrated_confidence(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    scored = calibration.calibrate(pairs, calibration.fit_platt(pairs))
    return scored.select("run_id", "confidence", F.round("calibrated", 6).alias("calibrated"))


# ---------------------------------------------------------------------------------------------
# Mining


@query
def keyword_frequency(spark, sf_dir):
    return mining.top_keywords(_documents(spark, sf_dir))


@query
def other_card_keywords(spark, sf_dir):
    """Keyword counts over the texts of the cards that ended as OTHER."""
    texts = mining.other_bucket(_cards(spark, sf_dir)).select("run_id", mining.card_text().alias("text"))
    return mining.top_keywords(texts)


@query
def tfidf_terms(spark, sf_dir):
    counted = mining.grams(_documents(spark, sf_dir), mining.KEYWORD_STOPWORDS)
    weights = mining.term_weights(counted)
    return weights.withColumn("weight", F.round("weight", 6))


@query
def cluster_other(spark, sf_dir):
    return mining.cluster_report(_documents(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with the human label where one exists, else the verdict."""
    decided = derived.decided(spark, sf_dir).withColumn("primary_category", F.coalesce("rule_code", F.lit("OTHER")))
    rk = _rk()
    other = F.array(*[F.lit(c) for c in CODES])[(rk % 10).cast("int")]
    return decided.withColumn("true_label", F.when((rk * 7919) % 10 == 9, other).otherwise(F.col("primary_category")))


@query
def gold_override(spark, sf_dir):
    cards = verdict_cards(spark, sf_dir)
    gold = derived.gold(derived.decided(spark, sf_dir)).filter(F.col("seq") % 4 == 0)
    return mining.with_gold(cards, gold).select("run_id", "primary_category", "true_label")


@query
def class_distribution(spark, sf_dir):
    return mining.class_distribution(_labelled(spark, sf_dir))


@query
def rule_mining_cube(spark, sf_dir):
    return mining.conjunction_rules(_labelled(spark, sf_dir))


@query
def rule_mining_tree(spark, sf_dir):
    return mining.tree_rules(mining.features(_labelled(spark, sf_dir), "true_label"))


@query
def tree_training_accuracy(spark, sf_dir):
    _, _, scored = mining.fit_tree(mining.features(_labelled(spark, sf_dir), "true_label"))
    return mining.training_accuracy(scored)


# ---------------------------------------------------------------------------------------------
# Log formats


@query
def history_steps(spark, sf_dir):
    return _step_rows(normalize_histories(derived_logs.histories(spark, sf_dir)))


@query
def event_table_steps(spark, sf_dir):
    events = event_pairing.event_rows(derived_logs.event_table(spark, sf_dir), plain_event)
    paired = event_pairing.pair_event_table(events, 8 * derived_logs.EVENT_SPAN)
    return event_pairing.step_rows(paired)


@query
def history_runs(spark, sf_dir):
    runs = normalize_histories(derived_logs.histories(spark, sf_dir))
    return runs.select(
        "run_id", "agent", F.col("task.task_id").alias("task_id"), F.size("steps").alias("step_count"), "final_patch",
        "resolved", F.col("test_result.passed").alias("passed"),
    )


@query
def ingest_batch(spark, sf_dir):
    """The batch rule: null outcomes fall back to the test block; how many runs are kept."""
    return ingest_counts(normalize_histories(derived_logs.histories(spark, sf_dir), strict_null=True))


def _run_rows(runs: DataFrame, *more: str) -> DataFrame:
    return runs.select(
        "run_id", "agent", F.col("task.task_id").alias("task_id"), F.size("steps").alias("step_count"), "resolved", *more)


@query
def sdk_runs(spark, sf_dir):
    return _run_rows(normalize_sdk(derived_logs.sdk_traces(spark, sf_dir)))


@query
def transcript_line_steps(spark, sf_dir):
    return event_pairing.step_rows(transcript_lines.transcript_line_steps(derived_logs.transcript_lines(spark, sf_dir)))


@query
def transcript_runs(spark, sf_dir):
    return _run_rows(normalize_sessions(derived_logs.transcripts(spark, sf_dir)))


@query
def chat_runs(spark, sf_dir):
    return _run_rows(normalize_chats(derived_logs.chats(spark, sf_dir)), "final_patch")


@query
def sdk_steps(spark, sf_dir):
    return _step_rows(normalize_sdk(derived_logs.sdk_traces(spark, sf_dir)))


@query
def action_list_steps(spark, sf_dir):
    return _step_rows(normalize_action_lists(derived_logs.action_lists(spark, sf_dir)))


@query
def action_list_runs(spark, sf_dir):
    runs = normalize_action_lists(derived_logs.action_lists(spark, sf_dir))
    return runs.select(
        "run_id", "model", F.col("task.repo").alias("repo"), F.col("task.problem_statement").alias("problem_statement"),
        "final_patch", "resolved", F.col("metadata")["exit_status"].alias("exit_status"),
        F.col("metadata")["api_calls"].alias("api_calls"),
    )


@query
def transcript_steps(spark, sf_dir):
    return _step_rows(normalize_sessions(derived_logs.transcripts(spark, sf_dir)))


@query
def session_summary_steps(spark, sf_dir):
    return _step_rows(normalize_sessions(derived_logs.summaries(spark, sf_dir)))


@query
def session_summary_runs(spark, sf_dir):
    runs = normalize_sessions(derived_logs.summaries(spark, sf_dir))
    return runs.select(
        "run_id", "resolved", "final_patch", F.col("metadata")["error"].alias("error"),
        F.col("metadata")["exit_status"].alias("exit_status"), F.col("metadata")["cost"].alias("cost"),
    )


@query
def chat_steps(spark, sf_dir):
    return _step_rows(normalize_chats(derived_logs.chats(spark, sf_dir)))


@query
def all_formats(spark, sf_dir):
    """Runs of all six kinds of logs in one table, counted by agent."""
    runs = union_runs(
        normalize_histories(derived_logs.histories(spark, sf_dir)),
        normalize_sdk(derived_logs.sdk_traces(spark, sf_dir)),
        normalize_sessions(derived_logs.transcripts(spark, sf_dir)),
        normalize_action_lists(derived_logs.action_lists(spark, sf_dir)),
        normalize_sessions(derived_logs.summaries(spark, sf_dir)),
        normalize_chats(derived_logs.chats(spark, sf_dir)),
    )
    return runs.groupBy("agent").agg(
        F.count("*").alias("runs"), F.sum(F.size("steps")).alias("steps"),
        F.count_if(step_ops.run_failed(F.col("resolved"), F.col("test_result.passed"))).alias("failed"),
    )


@query
def nested_cards(spark, sf_dir):
    """Cards straight from raw session records, in one pass without a shuffle."""
    runs = normalize_sessions(derived_logs.summaries(spark, sf_dir))
    return classify_runs(runs).select("run_id", "primary_category", "confidence", "classifier", "owner", "root_cause")


# ---------------------------------------------------------------------------------------------
# Windows


@query
def step_sessions(spark, sf_dir):
    """Sessions of the sample's steps, which end after twelve quiet hours."""
    return sessions_of(derived.steps(spark, sf_dir), "12 hours").select(
        "run_id", "session_start", "session_end", "step_count", "n_failed_steps", "n_edits", "n_tests", "n_finish", "last_edit",
        "unique_files_opened", "n_repeated_commands")


@query
def tumbling_fingerprints(spark, sf_dir):
    counted = fingerprint_windows(derived.steps(spark, sf_dir))
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "code", "count")

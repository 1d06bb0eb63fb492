import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions.sequence import join_by_chunk, with_ordinal, with_previous
from faultline.operators import calibration, evaluation, mining, views


def _pairs(spark, pairs):
    return spark.createDataFrame([(f"r{i}", t, p) for i, (t, p) in enumerate(pairs)], "run_id STRING, true STRING, predicted STRING")


@pytest.mark.parametrize("pairs, accuracy, kappa", [
    ([("A", "A"), ("B", "B")] * 2, 1.0, 1.0), ([("A", "A"), ("A", "B"), ("B", "A"), ("B", "B")], 0.5, 0.0),
    ([("A", "A")] * 3, 1.0, 1.0), ([], 0.0, 0.0),
])
def test_accuracy_and_kappa(spark, pairs, accuracy, kappa):
    row = evaluation.agreement(_pairs(spark, pairs)).first()
    assert (row.n, row.accuracy, row.kappa) == (len(pairs), accuracy, kappa)


def test_per_class_and_confusion(spark):
    pairs = _pairs(spark, [("A", "A"), ("A", "B"), ("C", "B")])
    scores = {r.label: (r.precision, r.recall, r.support) for r in evaluation.per_class(pairs).collect()}
    assert scores == {"A": (1.0, 0.5, 2), "B": (0.0, 0.0, 0), "C": (0.0, 0.0, 1)}
    grid = {(r.true, r.predicted): r["count"] for r in evaluation.confusion(pairs).collect()}
    assert len(grid) == 9 and grid["A", "B"] == 1 and grid["B", "B"] == 0


def test_bootstrap_matches_row_resampling(spark):
    rng = random.Random(1)
    pairs = [("A", "A")] * 40 + [("B", "B")] * 35 + [("A", "B")] * 15 + [("B", "A")] * 10
    found = evaluation.bootstrap_interval(_pairs(spark, pairs)).first()
    drawn = sorted(sum(t == p for t, p in rng.choices(pairs, k=100)) / 100 for _ in range(2000))
    assert found.accuracy_low == pytest.approx(drawn[50], abs=0.03)
    assert found.accuracy_high == pytest.approx(drawn[1949], abs=0.03)
    assert found.kappa_low < evaluation.agreement(_pairs(spark, pairs)).first().kappa < found.kappa_high
    assert found == evaluation.bootstrap_interval(_pairs(spark, pairs[::-1])).first()


def test_bootstrap_draws_rows_by_digest(spark):
    """Any statistic over the cells; the draws equal those of a plain loop over numbered rows."""
    pairs = [("A", "A")] * 7 + [("B", "A")] * 4 + [("é|", "x")] * 2 + [("", "A")]
    cell = sorted({(hashlib.md5(f"{t}|{p}".encode()).hexdigest()[:2], t, p) for t, p in pairs})
    rows = [(t, p) for _, t, p in cell for _ in range(pairs.count((t, p)))]

    def drawn(b):
        picked = [rows[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % len(rows)] for i in range(len(rows))]
        return sum(t == "A" for t, _ in picked)

    def a_share(cells, by):
        return cells.groupBy(*by).agg(F.sum(F.when(F.col("true") == "A", F.col("n")).otherwise(0)).cast("double").alias("a"))

    found = evaluation.bootstrap_statistics(_pairs(spark, pairs), a_share, iterations=40).collect()
    assert {r.replicate: r.a for r in found} == {b: drawn(b) for b in range(40)}
    bounds = evaluation.bootstrap_interval(_pairs(spark, pairs), 40, statistic=a_share).first()
    values = sorted(drawn(b) for b in range(40))
    assert tuple(bounds) == (values[1], values[38])
    empty = evaluation.bootstrap_interval(_pairs(spark, []), 10).first()
    assert set(empty) == {0.0}


@pytest.mark.parametrize("slot", [1, 5])
def test_bootstrap_slots_do_not_change_draws(spark, monkeypatch, slot):
    pairs = _pairs(spark, [("A", "A")] * 9 + [("B", "A")] * 4 + [("C", "B")])
    whole = sorted(evaluation.resampled_cells(pairs, 20).collect())
    monkeypatch.setattr(evaluation, "SLOT", slot)
    assert sorted(evaluation.resampled_cells(pairs, 20).collect()) == whole


def test_half_split_equals_a_global_rank(spark):
    pairs = _pairs(spark, [("A", "A")] * 31)
    found = {r.run_id: r.half for r in evaluation.half_split(pairs).collect()}
    ranked = pairs.withColumn("half", F.ntile(2).over(Window.orderBy(F.md5(F.concat(F.lit("42:"), "run_id")))))
    assert found == {r.run_id: r.half for r in ranked.collect()}


def test_annotators(spark):
    first = spark.createDataFrame([("1", " a", 0), ("1", "b", 1), ("2", "A", 0), ("3", "", 0)], "run_id STRING, label STRING, seq INT")
    labels = evaluation.load_labels(first, "label", "seq")
    assert sorted(map(tuple, labels.collect())) == [("1", "B"), ("2", "A")]
    few = evaluation.annotator_agreement(labels, labels).first()
    assert (few.n, few.enough_overlap) == (2, False)
    none = evaluation.annotator_agreement(labels, labels.limit(0)).first()
    assert (none.n, none.percent, none.kappa, none.band, none.enough_overlap) == (0, None, None, None, False)
    assert evaluation.annotator_agreement(labels, labels, 2).first().band == "Strong"


def _platt(rows, lr=0.1, steps=200):
    a, b = 1.0, 0.0
    for _ in range(steps):
        da = db = 0.0
        for x, y in rows:
            e = 1 / (1 + math.exp(-(a * x + b))) - y
            da, db = da + e * x, db + e
        a, b = a - lr * da / len(rows), b - lr * db / len(rows)
    return a, b


def test_platt_fit(spark):
    rows = [(0.9, True)] * 4 + [(0.9, False)] * 6 + [(0.6, True)] * 3 + [(0.2, False)]
    pairs = spark.createDataFrame(rows, "confidence DOUBLE, correct BOOLEAN")
    parameters = calibration.fit_platt(pairs, steps=20)
    fitted = parameters.first()
    assert (fitted.a, fitted.b) == pytest.approx(_platt(rows, steps=20), abs=1e-9)
    low = calibration.calibrate(pairs, parameters).filter("confidence = 0.9").first().calibrated
    assert low < 0.9
    with pytest.raises(ValueError):
        calibration.fit_platt(pairs.limit(1))


def test_bins_use_the_edge_products(spark):
    pairs = spark.createDataFrame([(0.6, True), (0.62, False), (1.0, True), (0.0, False)], "confidence DOUBLE, correct BOOLEAN")
    bins = {r.bin: r["count"] for r in calibration.reliability(pairs).collect()}
    assert bins == {2: 1, 3: 1, 0: 1}  # 0.6 lies below 3 * 0.2, and 1.0 has no bin
    error = calibration.calibration_error(pairs).first()
    assert error.n == 4 and error.mce == 0.62 and error.ece == pytest.approx((0.4 + 0.62) / 4)


def test_ordinal_and_previous_on_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("run_id"), (F.col("id") * 7919 % 5000).alias("ts"))
    plain = rows.withColumn("index", F.row_number().over(Window.partitionBy("run_id").orderBy("ts")) - 1)
    found = with_ordinal(rows.withColumn("bucket", F.floor(F.col("ts") / 100)), ["run_id"], "bucket", ["ts"]).drop("bucket")
    assert found.exceptAll(plain.select(found.columns)).count() == 0 and found.count() == 5000

    sizes = plain.groupBy("run_id").agg(F.count("*").alias("n"))
    spread = join_by_chunk(plain, sizes, "run_id", "index", "n", 64)
    assert spread.count() == 5000
    kept = spread.filter(F.col("index") % 97 == 5)
    linked = with_previous(kept, "run_id", "chunk", "index", F.col("index"), "previous").select("run_id", "index", "previous")
    expected = plain.filter(F.col("index") % 97 == 5).select(
        "run_id", "index", F.lag("index").over(Window.partitionBy("run_id").orderBy("index")).alias("previous"))
    assert sorted(linked.collect(), key=str) == sorted(expected.select(linked.columns).collect(), key=str)


def test_corrections_are_validated(spark):
    cards = spark.createDataFrame([("1", "OTHER")], "run_id STRING, primary_category STRING")
    schema = "run_id STRING, true_label STRING, note STRING, created_at DOUBLE"
    rows = views.correction_rows(spark.createDataFrame([("1", "scoping", None, 1.0), ("2", "OTHER", "n", 2.0)], schema), cards).collect()
    assert [(r.run_id, r.auto_label, r.true_label) for r in sorted(rows)] == [("1", "OTHER", "SCOPING"), ("2", "unknown", "OTHER")]
    with pytest.raises(Exception, match="unknown taxonomy code"):
        views.correction_rows(spark.createDataFrame([("1", "nope", None, 1.0)], schema), cards).collect()


def test_keywords_need_whole_words(spark):
    texts = spark.createDataFrame([("Timeout café timeout_x the ab TIMEOUT 9abc",)], "text STRING")
    assert [tuple(r) for r in mining.top_keywords(texts).collect()] == [("timeout", 2), ("timeout_x", 1)]


def test_few_other_cards_give_keywords(spark):
    cards = spark.createDataFrame(
        [("1", "OTHER", "strange failure", []), ("2", "SCOPING", "ignored", [])],
        "run_id STRING, primary_category STRING, root_cause STRING, evidence ARRAY<STRUCT<step_index: INT, excerpt: STRING, why: STRING>>")
    assert [r.term for r in mining.explain_other(cards, "keywords").collect()] == ["failure", "strange"]


def test_report_row(spark):
    row = evaluation.report(_pairs(spark, [("A", "A")] * 6 + [("A", "B"), ("B", "B")]), 200).first()
    assert row.n == 8 and row.accuracy == 0.875 and 0 <= row.accuracy_low <= 0.875 <= row.accuracy_high <= 1


def test_clusters_and_tree(spark):
    texts = spark.createDataFrame([(str(i), ["apple pie sugar", "engine wheel brake"][i % 2]) for i in range(20)], "run_id STRING, text STRING")
    report = {tuple(r.members): r["size"] for r in mining.cluster_report(texts, 2).collect()}
    assert sorted(report.values()) == [10, 10]
    rows = [("A" if i % 2 else "B", *[i % 2 if f == "no_file_edits" else 0 for f in mining.FEATURES]) for i in range(40)]
    labelled = spark.createDataFrame(rows, "true_label STRING, " + ", ".join(f"{f} INT" for f in mining.FEATURES))
    rules = [tuple(r) for r in mining.tree_rules(labelled).collect()]
    assert sorted(r[0] for r in rules) == ["A", "B"] and all(r[1] == 1.0 and r[2] == 20 and "no_file_edits" in r[3] for r in rules)


def test_conjunctions_equal_plain_counting(spark):
    flags = mining.FLAGS[:5]
    dice = random.Random(3)
    rows = [(*(dice.random() < 0.5 for _ in flags), "A" if dice.random() < 0.8 else "B") for _ in range(60)] + [(None,) * 5 + ("C",)] * 3
    labelled = spark.createDataFrame(rows, ", ".join(f"{f} BOOLEAN" for f in flags) + ", true_label STRING")
    want = set()
    for values in itertools.product((0, 1, None), repeat=5):
        hit = [r[5] for r in rows if all(v is None or int(bool(x)) == v for x, v in zip(r, values))]
        for label in set(hit):
            if len(hit) >= 3 and hit.count(label) / len(hit) >= 0.85:
                want.add((*values, label, round(hit.count(label) / len(hit), 4), len(hit)))
    assert {tuple(r) for r in mining.conjunction_rules(labelled, flags).collect()} == want and len(want) > 40
    assert mining.conjunction_rules(labelled.limit(2), flags).count() == 0


def test_vocabulary_ties_are_broken_by_term(spark):
    texts = spark.createDataFrame([("zeta alpha", ), ("alpha zeta beta",), ("beta",), (None,)], "text STRING")
    for parts in (1, 5):
        counted = mining.grams(texts.repartition(parts), [])
        top = [tuple(r) for r in mining.term_weights(counted, 4).orderBy(F.desc("count"), "term").collect()]
        assert [(t, n, d) for t, n, d, _ in top] == [("alpha", 2, 2), ("beta", 2, 2), ("zeta", 2, 2), ("alpha zeta", 1, 1)]
        assert top[0][3] == pytest.approx(math.log(5 / 3) + 1)
        _, vocabulary = mining.tfidf(texts.repartition(parts), 4, [])
        assert vocabulary == [t for t, *_ in top]


def test_pairs_are_counted_only_among_frequent_words(spark, monkeypatch):
    dice = random.Random(8)
    texts = [" ".join(dice.choice(["aa", "bb", "cc", "dd", f"w{dice.randrange(3000)}"]) for _ in range(40)) for _ in range(60)] + ["", None]
    held = {}

    def counted(rows, *keys, old=mining._counts):
        held[keys] = old(rows, *keys)
        return held[keys]

    monkeypatch.setattr(mining, "_counts", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    top = mining.term_weights(mining.grams(rows, []), 4).orderBy(F.desc("count"), "term").collect()
    plain, documents = Counter(), Counter()
    for words in ((t or "").split() for t in texts):
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        plain.update(terms)
        documents.update(set(terms))
    best = sorted(plain, key=lambda t: (-plain[t], t))[:4]
    assert [(r.term, r["count"], r.document_count) for r in top] == [(t, plain[t], documents[t]) for t in best]
    assert held[("a", "b")].count() <= 16


def test_clusters_keep_the_best_start(spark):
    dice = random.Random(8)
    words = ["apple", "pie", "sugar", "engine", "wheel", "brake", "moon", "star", "comet", "salt"]
    texts = spark.createDataFrame([(str(i), " ".join(dice.choices(words, k=5))) for i in range(60)], "run_id STRING, text STRING")
    vectors, _ = mining.tfidf(texts)
    model, costs = mining.best_of_starts(vectors, 3)
    assert len(costs) == mining.STARTS and model.summary.trainingCost == min(costs) < max(costs)
    once = sorted(map(tuple, mining.cluster_texts(texts.repartition(1))[0].collect()))
    assert once == sorted(map(tuple, mining.cluster_texts(texts.repartition(7))[0].collect()))

"""Scores of the two classifiers against plain versions, through the operators that give them."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from faultline.llm import labelled, lexicon, quality, toxicity


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(11)
    words = ["Good", "prose,", "the", "of", "1234", "$$$", "BUY", "now!!!", "été", "line\n", "x" * 90, "日本", '"', "you"]
    return [None, "", " ", "\n\n"] + [" ".join(dice.choices(words, k=dice.randint(1, 60))) for _ in range(60)] + ["word " * 20_000]


def rows(spark, texts):
    held = [(i, t, 7.0, "k") for i, t in enumerate(texts)] + [(None, "x", 1.0, "k"), (3, "again", 1.0, "k"), (3, "again", 1.0, "k")]
    return held, spark.createDataFrame(held, "doc_id long, text string, score double, predicted string").repartition(3)


def test_quality_equals_all_pairs_of_the_machine(spark, texts):
    """The score by its definition: a sum over all pairs of features, not the sum-of-squares identity."""
    dice = np.random.default_rng(5)
    width = quality.BUCKETS + 16
    model = quality.Model(
        -0.3, dice.normal(0, 0.5, width).astype(np.float32), dice.normal(0, 0.3, (width, quality.RANK)).astype(np.float32),
        dice.normal(0, 0.1, 16), np.abs(dice.normal(1, 0.1, 16)))

    def plain(text):
        text = text or ""
        words = text.split()
        counts = Counter(xxhash.xxh3_64_intdigest(w.lower()) % quality.BUCKETS for w in words)
        norm = math.sqrt(sum(n * n for n in counts.values())) or 1.0
        x = {b: n / norm for b, n in counts.items()}
        ids = np.array([xxhash.xxh3_64_intdigest(w.lower()) % quality.BUCKETS for w in words], np.int64)
        for i, value in enumerate(quality._shape(text, words, ids)):
            x[quality.BUCKETS + i] = min(3.0, max(-3.0, (value - model.mean[i]) / model.scale[i]))
        keys = sorted(x)
        score = model.bias + sum(float(model.linear[k]) * x[k] for k in keys)
        for n, i in enumerate(keys):
            for j in keys[n + 1:]:
                score += float(model.factors[i].astype(float) @ model.factors[j].astype(float)) * x[i] * x[j]
        return 1 / (1 + math.exp(-score))

    held, docs = rows(spark, texts)
    found = sorted((str(r["doc_id"]), r["score"]) for r in quality.quality(docs, model).collect())
    wanted = sorted((str(r[0]), plain(r[1])) for r in held)
    assert [f[0] for f in found] == [w[0] for w in wanted]
    assert all(math.isclose(f[1], w[1], abs_tol=1e-4) for f, w in zip(found, wanted))
    kept = quality.of_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(w[1] >= 0.5 for w in wanted)
    assert quality.quality(docs.limit(0), model).count() == 0


def test_fits_leave_no_tables_in_the_driver(spark):
    held = [(i, f"word{i} you are a wretch{i % 2} today", i % 2, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in held], "doc_id long, toxic int, quality int")
    for module, table, label in ((toxicity, toxicity._AUTOMATA, "toxic"), (quality, quality._BUCKET, "quality")):
        model = module.model_of(docs, labels)
        assert not table
        plain = module.fit(labelled.training_sample(docs, labels, label, 100))
        assert table and module.probabilities([held[0][1], ""], model) == module.probabilities([held[0][1], ""], plain)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_toxicity_equals_a_plain_window_score(spark):
    """Every word against every term by edit distance, then the window score and the logistic weights."""
    terms, weights = ("idiot$", "worthless$", "lowlife"), (-3.5, 4.0, 1.2, -1.0, -2.0)
    model = toxicity.Model(terms, weights)
    dice = random.Random(3)
    words = ["you", "are", "an", "idiot", "idiots", "idoit", "worthles", "wortless", "worthless", "lowlifes", "lowlyfe", "he", "said", '"', "term", "book", "du", "fine"]
    texts = [None, "", "IDIOT!", '"idiot" is an insult'] + [" ".join(dice.choices(words, k=dice.randint(1, 30))) for _ in range(200)]

    def hit(word):
        """Number of edits of the nearest term, if some term is near enough."""
        best = None
        for term in terms:
            own, most = lexicon.stem(term), lexicon.edits(term)
            heads = [word] if term.endswith(lexicon.END) else [word[:n] for n in range(len(word) + 1)]
            least = min(edit_distance(own, h) for h in heads)
            if least <= most and (best is None or least < best):
                best = least
        return best

    def plain(text):
        tokens = toxicity.TOKEN.findall((text or "").lower())
        hits = {t: hit(t) for t in set(tokens) if len(t) >= 3 and hit(t) is not None}
        if not hits:
            return 1 / (1 + math.exp(-weights[0]))
        plain_sum = fuzzy = quoted = 0.0
        places = [i for i, t in enumerate(tokens) if t in hits]
        for i in places:
            around = tokens[max(0, i - 6):i] + tokens[i + 1:i + 7]
            marks = any(t in toxicity.QUOTES for t in tokens[max(0, i - 2):i]) and any(t in toxicity.QUOTES for t in tokens[i + 1:i + 3])
            quote = 0.6 * marks + 0.4 * any(t in toxicity.REPORTING for t in around)
            weight = max(0.0, 1 + 0.25 * any(t in toxicity.ADDRESS for t in around) + 0.25 * any(t in hits for t in around) - quote)
            fuzzy += hits[tokens[i]] > 0
            plain_sum += weight * (0.7 if hits[tokens[i]] else 1.0)
            quoted += quote
        x = (1, 1, math.log1p(plain_sum), fuzzy / len(places), quoted / len(places))
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))

    held, docs = rows(spark, texts)
    found = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity(docs, model).collect())
    wanted = sorted((str(r[0]), plain(r[1])) for r in held)
    assert [f[0] for f in found] == [w[0] for w in wanted]
    assert all(math.isclose(f[1], w[1], rel_tol=1e-9) for f, w in zip(found, wanted))
    assert len({round(w[1], 6) for w in wanted}) > 30
    assert toxicity.toxicity(docs.limit(0), model).count() == 0

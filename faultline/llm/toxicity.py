"""Toxicity: learned terms, also misspelled, weighed by the words around them.

``fit`` learns a lexicon and the weights of a small logistic model from labelled texts. ``score`` runs the
lexicon's automaton over every distinct word of a slice of texts, and looks at the window around each hit:
quotation marks and words of reporting speak for a quotation, address and further hits for abuse.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import slices, strings
from faultline.llm.labelled import forgotten, training_sample
from faultline.llm.lexicon import WORD, Automaton, learn, times

MOST_ROWS = 8_000
MOST_TERMS = 256
WINDOW = 6
TABLE_ENTRIES = 200_000

#: Words that report or name speech, and words that address someone.
REPORTING = frozenset(
    "said says wrote writes called quoted quote word term slur insult meaning "
    "sagte schrieb nannte zitat wort beleidigung dit écrit cité mot insulte dijo escribió palabra cita insulto".split())
ADDRESS = frozenset("you your yours u ur du dich dein deine ihr euch tu toi ton vous votre tú usted eres vosotros".split())
QUOTES = frozenset("\"'«»“”„‘’`")
TOKEN = re.compile(rf"{WORD.pattern}|[\"'«»“”„‘’`]")

#: Prior weights (bias, any hit, hits, fuzzy hits, quoted hits); labelled rows move them.
PRIOR = np.array([-4.0, 5.0, 1.5, -1.5, -2.5])

_AUTOMATA: dict[tuple[str, ...], tuple[Automaton, set[str], dict[str, tuple[str, int]]]] = {}


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    weights: tuple[float, ...]


def _automaton(terms: tuple[str, ...]) -> tuple[Automaton, set[str], dict[str, tuple[str, int]]]:
    if terms not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[terms] = (Automaton(list(terms)), set(), {})
    return _AUTOMATA[terms]


def _window_features(text: str, hits: dict[str, tuple[str, int]]) -> list[float]:
    tokens = TOKEN.findall(text)
    places = [i for i, t in enumerate(tokens) if t in hits]
    plain = fuzzy = quoted = 0.0
    for i in places:
        around = tokens[max(0, i - WINDOW):i] + tokens[i + 1:i + 1 + WINDOW]
        near = any(t in QUOTES for t in tokens[max(0, i - 2):i]) and any(t in QUOTES for t in tokens[i + 1:i + 3])
        quote = 0.6 * near + 0.4 * any(t in REPORTING for t in around)
        abuse = 0.5 * any(t in ADDRESS for t in around) + 0.5 * any(t in hits for t in around)
        weight = max(0.0, 1.0 + 0.5 * abuse - quote)
        if hits[tokens[i]][1]:
            fuzzy += 1.0
            weight *= 0.7
        quoted += quote
        plain += weight
    n = max(1, len(places))
    return [1.0, 1.0, float(np.log1p(plain)), fuzzy / n, quoted / n]


def features(texts: list[str], terms: tuple[str, ...]) -> np.ndarray:
    """One row per text: bias, any hit, weighed hits, and the shares of misspelled and of quoted hits."""
    automaton, clean, hits = _automaton(terms)
    if len(clean) > TABLE_ENTRIES:
        clean.clear()
    found = np.zeros((len(texts), len(PRIOR)))
    found[:, 0] = 1.0
    for row, text in enumerate(texts):
        lowered = text.lower()
        chunks = set(lowered.split())
        bad = False
        for chunk in chunks - clean:
            words = [w for w in WORD.findall(chunk) if len(w) >= 3]
            matched = False
            for w in words:
                if w in hits:
                    matched = True
                elif (hit := automaton.find(w)) is not None:
                    matched = True
                    if len(hits) < TABLE_ENTRIES:
                        hits[w] = hit
            if matched:
                bad = True
            elif len(chunk) <= 48:
                clean.add(chunk)
        if bad:
            words = Counter(w for w in WORD.findall(lowered) if len(w) >= 3)
            own = {w: hits.get(w) or automaton.find(w) for w in words}
            seen: Counter[str] = Counter()
            for w, hit in own.items():
                if hit is not None:
                    seen[hit[0]] += words[w]
            counted = {w: h for w, h in own.items() if h is not None and seen[h[0]] >= times(h[0])}
            if counted:
                found[row] = _window_features(lowered, counted)
    return found


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], most_terms: int = MOST_TERMS) -> Model:
    """Lexicon and weights. Without rows of both labels the model has no terms and the prior's weights."""
    terms = tuple(learn(rows, most_terms))
    weights = PRIOR.copy()
    if rows:
        x, y = features([t for t, _ in rows], terms), np.array([float(v) for _, v in rows])
        for _ in range(30):  # Newton steps towards the penalized optimum
            p = _sigmoid(x @ weights)
            slope = x.T @ (p - y) + (weights - PRIOR)
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(PRIOR))
            weights = weights - np.linalg.solve(curve, slope)
    return Model(terms, tuple(float(w) for w in weights))


def probabilities(texts: list[str], model: Model) -> list[float]:
    return _sigmoid(features(texts, model.terms) @ np.array(model.weights)).tolist()


def scored(docs: DataFrame, score: Callable[[list[str]], list[float]], text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score``. A null text is scored as the empty text."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = pa.array(score(strings(batch, text)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def filtered(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """The rows, all columns of them, whose text ``keep`` accepts. A null text is judged as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(strings(batch, text)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def model_of(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fitted on at most ``most_rows`` labelled rows; held-out rows (crc32 modulo 3 is 1) take no part."""
    model = fit(training_sample(docs, labels, "toxic", most_rows))
    forgotten(_AUTOMATA)
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row: empty texts and an empty lexicon score the bias alone.

    Null or repeated ids keep their rows, an empty table gives none, other columns are not read.
    """
    return scored(docs.select("doc_id", "text"), lambda texts: probabilities(texts, model)).select("doc_id", "score")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows that score below ``limit``."""
    return filtered(docs, lambda texts: [p < limit for p in probabilities(texts, model)])


def predicted(scores: DataFrame, limit: float) -> DataFrame:
    from faultline.llm.common import remainder

    return scores.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))

"""Quality: a factorisation machine over hashed words and structure statistics.

A text is a sparse vector: its words hashed into ``BUCKETS`` and scaled to length one, and the statistics of
its shape, bounded to [-3, 3]. The score is w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the pairwise interactions in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from faultline.llm.labelled import forgotten, training_sample
from faultline.llm.toxicity import filtered, scored

MOST_ROWS = 12_000
BUCKETS = 4096
RANK = 6
EPOCHS = 12
TABLE_ENTRIES = 200_000

_BUCKET: dict[str, int] = {}


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _buckets(words: list[str]) -> np.ndarray:
    if len(_BUCKET) > TABLE_ENTRIES:
        _BUCKET.clear()
    missing = set(words).difference(_BUCKET)
    fresh = {w: xxhash.xxh3_64_intdigest(w) % BUCKETS for w in missing}
    _BUCKET.update((w, b) for w, b in fresh.items() if len(w) <= 48)
    if any(len(w) > 48 for w in missing):
        return np.fromiter((fresh[w] if w in fresh else _BUCKET[w] for w in words), np.int64, len(words))
    return np.fromiter(map(_BUCKET.__getitem__, words), np.int64, len(words))


def _shape(text: str, words: list[str], ids: np.ndarray) -> list[float]:
    """Statistics of the text's shape; all are 0 for the empty text."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * 16
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    blanks, breaks = counts[9:14].sum() + counts[32], counts[10]
    points = counts[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum()
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - points
    share = counts[counts > 0] / n
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    top = np.bincount(ids).max() / k if len(ids) else 0.0
    again = float(np.count_nonzero(ids[1:] == ids[:-1])) / k if len(ids) > 1 else 0.0
    return [
        np.log1p(n), np.log1p(len(words)), n / k, upper / n, upper / max(1, upper + lower), digits / n, signs / n * 4,
        points / n, (n - blanks) / n, breaks / k, counts[128:].sum() / n, len(set(words)) / k, top, again,
        1 - len(set(lines)) / max(1, len(lines)), float(-(share * np.log2(share)).sum()),
    ]


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (scaled to length one) and shape statistics, one row per text."""
    hashed, shape = np.zeros((len(texts), BUCKETS), np.float32), np.zeros((len(texts), 16))
    for row, text in enumerate(texts):
        words = text.split()
        ids = _buckets([w.lower() for w in words])
        if len(ids):
            counts = np.bincount(ids, minlength=BUCKETS)
            hashed[row] = counts / np.sqrt((counts * counts).sum())
        shape[row] = _shape(text, words, ids)
    return hashed, shape


def _inputs(texts: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    hashed, shape = vectors(texts)
    return np.hstack([hashed, np.clip((shape - mean) / scale, -3, 3).astype(np.float32)])


def _raw(x: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = x @ factors
    return bias + x @ linear + 0.5 * ((sums * sums).sum(1) - (x * x) @ (factors * factors).sum(1)), sums


def probabilities(texts: list[str], model: Model) -> list[float]:
    raw, _ = _raw(_inputs(texts, model.mean, model.scale), model.bias, model.linear, model.factors)
    return (1.0 / (1.0 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))).tolist()


def _chunks(rows: list[tuple[str, int]], order: np.ndarray, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
    for start in range(0, len(order), size):
        at = order[start:start + size]
        yield [rows[i][0] for i in at], np.array([rows[i][1] for i in at], np.float32)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Minibatch descent with adaptive steps on the log loss. Rows of one label only, or none, give a constant.

    Rare labels weigh more, up to four times, so that both sides count.
    """
    width = BUCKETS + 16
    random = np.random.default_rng(seed)
    linear, factors = np.zeros(width, np.float32), random.normal(0, 0.02, (width, RANK)).astype(np.float32)
    ones = sum(y for _, y in rows)
    bias = float(np.log((ones + 1) / (len(rows) - ones + 1)))
    if not ones or ones == len(rows):
        return Model(bias, linear, factors * 0, np.zeros(16), np.ones(16))
    stored, labels = [], np.array([y for _, y in rows], np.float32)
    shapes = []
    for texts, _ in _chunks(rows, np.arange(len(rows)), 256):
        hashed, shape = vectors(texts)
        shapes.append(shape)
        for row in hashed:
            at = np.flatnonzero(row)
            stored.append((at.astype(np.int16), row[at]))
    shape = np.vstack(shapes)
    mean, scale = shape.mean(0), shape.std(0) + 1e-6
    shape = np.clip((shape - mean) / scale, -3, 3).astype(np.float32)
    weight = np.where(labels == 1, min(4.0, len(rows) / (2 * ones)), min(4.0, len(rows) / (2 * (len(rows) - ones))))
    state = [np.zeros_like(linear), np.zeros_like(linear), np.zeros_like(factors), np.zeros_like(factors)]
    step = 0
    for _ in range(epochs):
        for at in np.array_split(random.permutation(len(rows)), max(1, len(rows) // 128)):
            x = np.zeros((len(at), width), np.float32)
            for r, i in enumerate(at):
                x[r, stored[i][0]] = stored[i][1]
            x[:, BUCKETS:] = shape[at]
            raw, sums = _raw(x, bias, linear, factors)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[at]) * weight[at] / len(at)).astype(np.float32)
            g_linear = x.T @ error + 1e-5 * linear
            g_factors = x.T @ (error[:, None] * sums) - factors * ((x * x).T @ error)[:, None] + 1e-4 * factors
            bias -= 0.05 * float(error.sum())
            step += 1
            for value, grad, m, v in ((linear, g_linear, *state[:2]), (factors, g_factors, *state[2:])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return Model(bias, linear, factors, mean, scale)


def model_of(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fitted on at most ``most_rows`` labelled rows; held-out rows (crc32 modulo 3 is 1) take no part."""
    model = fit(training_sample(docs, labels, "quality", most_rows))
    forgotten(_BUCKET)
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row; the empty and the null text get the score of zero statistics.

    Null or repeated ids keep their rows, an empty table gives none, other columns are not read.
    """
    return scored(docs.select("doc_id", "text"), lambda texts: probabilities(texts, model)).select("doc_id", "score")


def of_quality(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows that score ``limit`` or more."""
    return filtered(docs, lambda texts: [p >= limit for p in probabilities(texts, model)])

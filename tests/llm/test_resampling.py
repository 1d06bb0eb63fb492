"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from faultline.llm import resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, buckets, percent, least):
    """(key, n_features, weight, score, rank) per row, by counting everything in one place."""
    found = [(key, *features(text)) for key, text in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for key, words, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, row in enumerate(drawn[:percent * len(drawn) // 100]):
        row[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(docs, target, **given):
    rows = resampling.resampled(docs, target, 5, **given).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, rows.collect()), key=str)


def test_whole_sample_equals_the_plain_version(spark, sample):
    docs, target = (spark.read.parquet(f"{sample}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert drawn(docs.repartition(3), target) == plain(pairs, [r["text"] for r in target.collect()], 10_000, 5, 20)


def test_odd_rows(spark):
    dice = random.Random(4)
    parts = ["a", "B", "é", "İ", "1", " ", ". ", "\n", "\x00", "日本", "_", "~", "\x7f", "Zz"]
    rows = [(i, "".join(dice.choices(parts, k=dice.randint(0, 60)))) for i in range(120)]
    rows += [(7, None), (None, "a b"), (None, None), (8, ""), (9, " . "), (500, "word " * 60_000), (501, "x" * 70_000)]
    rows += [(None, "a b é 1 " * 9)] * 40 + rows[:20]  # ties in score and key
    docs = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, weight int, rank string, _row double")
    target = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    got, want = drawn(docs.repartition(4), target, buckets=97, percent=30, least_words=3), plain(rows, ["a b", None, ""], 97, 30, 3)
    # Rows equal in score and key may take either rank.
    assert sorted(map(str, (g[:4] for g in got))) == sorted(map(str, (w[:4] for w in want)))
    key = lambda r: (r[4], r[0], r[3])
    assert sorted(map(key, (g for g in got if g[4]))) == sorted(map(key, (w for w in want if w[4])))
    assert drawn(docs.limit(0), target) == []
    assert {r[4] for r in drawn(docs.limit(4), target.limit(0), least_words=10_000)} == {None}


@pytest.mark.parametrize("most", [1, 40, 1 << 22])
def test_slices_do_not_change_the_counts(spark, monkeypatch, most):
    monkeypatch.setattr(resampling, "SLICE", most)
    docs = spark.createDataFrame([("a b c a b",), ("b c",), (None,), ("c",)], "text string").coalesce(1)
    counts = {r["bucket"]: r["n"] for r in resampling.bucket_counts(docs, 1000).collect()}
    want = Counter(zlib.crc32(f.encode()) % 1000 for t in ("a b c a b", "b c", "c") for f in features(t)[1])
    assert counts == want

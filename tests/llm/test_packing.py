"""Packing: every id in exactly one piece, sequences without gaps, ids as the library gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from faultline.llm import packing  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "a", "b", "Foo", "é", "▁", "1", "23", "'s", "'", "!", "<|endoftext|>", "\x1c", "\xa0", "\t", "日本", '"', "(", "\n\n",
         " ", "　", "\x00", "ß", "º"]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(model):
    dice = random.Random(3)
    texts = ["".join(dice.choices(p, k=dice.randint(0, 12))) for p in (PARTS, [" ", "\n", "ab", "Cd", "é", ".", "'s", '"', "("]) for _ in range(8000)]
    got = packing.Encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("entries, piece", [(3, 40), (500_000, 1 << 20)])
def test_table_limits_and_long_texts_do_not_change_ids(model, monkeypatch, entries, piece):
    monkeypatch.setattr(packing, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(packing, "PIECE", piece)
    texts = ["x" * 70_000, "word " * 20_000, "é" * 9_000 + " b", "a\n\n\nb  c " * 900, "It's  fine.\n" * 30]
    own = packing.Encoder(PATH)
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids


def held_together(spark, model, rows, size, parts):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, part int, ids string").repartition(parts)
    records = packing.packed(docs, PATH, 0, size).cache()
    ids_of = [(key, tuple(model.encode(text or "", add_special_tokens=False).ids) + (0,)) for key, text in rows]
    total = sum(len(ids) for _, ids in ids_of)
    sequences = {r["sequence_id"]: r for r in packing.sequences(records, size).collect()}
    assert sorted(sequences) == list(range(-(-total // size)))
    assert sum(r["n_tokens"] for r in sequences.values()) == total
    assert all(r["n_tokens"] == size for i, r in sequences.items() if i < total // size)
    inside, ends = defaultdict(list), defaultdict(list)
    for r in packing.piece_rows(records).collect():
        inside[r["sequence_id"]].append(r)
    for i, pieces in inside.items():
        pieces.sort(key=lambda r: r["offset"])
        ids, at = np.frombuffer(sequences[i]["ids"], "<u2"), 0
        assert [p["offset"] for p in sequences[i]["pieces"]] == [p["offset"] for p in pieces]
        for p in pieces:
            assert p["offset"] == at
            at += p["length"]
            mine = ids[p["offset"]:at]
            assert zlib.crc32(mine.astype("<u4").tobytes()) == p["ids_crc32"]
            ends[p["doc_id"]].append((i, p["offset"], p["start"], p["doc_tokens"], tuple(mine.tolist())))
        assert at == sequences[i]["n_tokens"]
    documents = Counter()
    for key, pieces in ends.items():
        whole: tuple = ()
        for _, _, start, n, mine in sorted(pieces):  # a document's pieces follow one another in the stream
            assert start == len(whole)
            whole += mine
            if len(whole) == n:
                documents[key, whole] += 1
                whole = ()
        assert whole == ()
    assert documents == Counter(ids_of)


@pytest.mark.parametrize("size", [16, 64, 1024])
def test_packing_round_trip(spark, model, size):
    dice = random.Random(2)
    rows = [(i, "".join(dice.choices(PARTS, k=dice.randint(0, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, "x" * 30_000), (1002, "word " * 5_000)] + rows[:20] + [(None, "a"), (None, None)]
    held_together(spark, model, rows, size, 5)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs, PATH, 0).count() == 0
    assert packing.sequences(packing.packed(docs, PATH, 0), 1024).count() == 0

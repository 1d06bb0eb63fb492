"""Each operator against the library it must equal, or against a plain version of its contract."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from faultline.llm import decontaminate, fingerprints, language_model, lexicon, near_dedup, pieces, quality, token_counts  # noqa: E402
from faultline.llm import token_files, toxicity, warc  # noqa: E402

PARTS = [" ", "  ", "\n", "a", "b", "Foo", "é", "▁", "1", "23", "'s", "'", "!", "<|endoftext|>", "\x1c", "\xa0", "\t", "日本",
         "<s>", "</s>", "\x00", "İ", "́", "🙂", "Σ", "ς", "the"]


@pytest.fixture(scope="module")
def odd():
    """Rows with nulls, empty and long texts, ties and repeated rows."""
    dice = random.Random(1)
    texts = [None, "", " ", "▁"] + ["".join(dice.choices(PARTS, k=dice.randint(0, 40))) for _ in range(300)]
    texts += ["x" * 70_000, "word " * 20_000, "a1" * 40_000, "é" * 70_000 + " b"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "abc"), (None, None), (5, "abc"), (5, "abc")]


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    """With a column whose name clashes with ones the operators use."""
    rows = [(i, t, 1, "k") for i, t in odd]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, ids string").repartition(3)


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece_equals_the_library(odd, odd_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = []
    for i, t in odd:
        ids = model.encode(t or "") + [2]
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    encoded = pieces.encode_decode(odd_docs, path)
    assert ordered(pieces.digests(encoded, "doc_id").collect()) == ordered(wanted)
    assert pieces.encode_decode(odd_docs.limit(0), path).count() == 0


@pytest.mark.parametrize("core, overlap", [(32_768, 512), (64, 8)])
def test_token_counts_equal_the_library(odd, odd_docs, core, overlap):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    wanted = [(i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in odd]
    assert ordered(token_counts.count_tokens(odd_docs, path, core=core, overlap=overlap).collect()) == ordered(wanted)


def test_token_counts_look_up_each_part_of_a_word_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, model = token_counts.Counter(path), Tokenizer.from_file(path)
    words = ["alpha", "beta", "gamma", "Delta", "é"] * 4
    texts = [" ".join(a + w + b for w in words) + "\nend" for a in ("", "(", '"', "[") for b in ("", ".", ",", ").", "!?")] + ["", "a\tb  \n c", "<|endoftext|>"]
    texts.append(" ".join(f"w{i}" for i in range(500)) + " " * 5)
    assert own.count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
    own = token_counts.Counter(path)
    own.words = type(own.words)(path)  # a table of its own
    own.count(texts[:20])
    assert 0 < len(own.words.kept) < 30  # 100 distinct words of letters and signs


def test_token_counts_of_a_tokenizer_that_does_not_part_words(monkeypatch):
    def refused(path):
        raise ValueError

    monkeypatch.setattr(token_counts, "encoder", refused)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, model = token_counts.Counter(path), Tokenizer.from_file(path)
    texts = ["alpha beta, gamma.", "a  b\n c", "", "é " * 30]
    assert own.words is None and own.count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_files_round_trip(odd, odd_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    wanted = []
    for i, t in odd:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    rows = token_files.digests(token_files.round_trip(odd_docs, path, 2, 4)).collect()
    assert ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == ordered(wanted)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(odd_docs.limit(0), path, 2, 4).count() == 0


def test_blocks_decode_segment_by_segment_and_notice_damage():
    import numpy as np

    ids = np.random.default_rng(1).zipf(1.3, 300_000) % 50_000
    table = token_files.Table(np.bincount(ids))
    data = token_files.pack(table, [7, None], [ids[:1000].astype("<u4").tobytes(), ids[1000:].astype("<u4").tobytes()], "<u4")
    packed = token_files.Packed(data)
    assert packed.segments > 1 and packed.doc_ids == [7, None] and packed.lengths.tolist() == [1000, 299_000]
    found = [packed.segment(table, i) for i in reversed(range(packed.segments))]
    assert b"".join(reversed(found)) == ids.astype("<u4").tobytes()
    with pytest.raises(ValueError):
        token_files.Packed(data[:500] + bytes([data[500] ^ 1]) + data[501:])


def plain_groups(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < size else {tuple(w[a:a + size]) for a in range(len(w) - size + 1)}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        shared.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((root(a), root(b)))
            least[high] = low
    return [(i, len(sets[i]), root(i), root(i) == i) for i in sets]


def test_near_duplicates_equal_all_pairs(spark):
    dice = random.Random(3)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for _ in range(12):
        base = dice.choices(words, k=120)
        for _ in range(dice.choice([1, 2, 5, 40])):
            text = list(base)
            for _ in range(dice.randint(0, 5)):
                text[dice.randrange(120)] = dice.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "a b", "A b", "a  b ", "x", "x y z q"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(near_dedup.near_duplicates(docs, 4, 80).collect()) == ordered(plain_groups(rows, 4, 80))
    left = near_dedup.without_duplicates(docs, 5, 80)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r[0] for r in plain_groups(rows, 5, 80) if r[3])


def star(dice, words, edits, first):
    """One text of 300 words, and edits of it that are near it and not near one another."""
    base = dice.choices(words, k=300)
    rows = []
    for _ in range(edits):
        text = list(base)
        for at in dice.sample(range(0, 300, 4), 6):
            text[at] = dice.choice(words)
        rows.append((first + len(rows), " ".join(text)))
    return rows + [(first + edits, " ".join(base))]


@pytest.mark.parametrize("edits", [300, 2000])
def test_near_duplicates_of_stars_equal_all_pairs(spark, edits):
    dice = random.Random(8)
    words = [f"w{i}" for i in range(50_000)]
    rows = star(dice, words, edits, 0)
    sets = [set(zip(w, w[1:], w[2:], w[3:])) for w in (t.split() for _, t in rows)]
    assert all(100 * len(s & sets[-1]) >= 80 * len(s | sets[-1]) for s in sets)
    assert not any(100 * len(s & sets[0]) >= 80 * len(s | sets[0]) for s in sets[1:-1])
    wanted = [(i, len(s), 0, i == 0) for (i, _), s in zip(rows, sets)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80)
    assert ordered(found.collect()) == ordered(wanted)


def test_exact_join_links_what_no_single_member_holds_together(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    dice = random.Random(9)
    words = [f"w{i}" for i in range(50_000)]
    shared, rows = dice.choices(words, k=200), []
    for _ in range(40):  # pairs near each other, in a crowd that is alike below the threshold
        text = shared + dice.choices(words, k=40)
        for _ in range(2):
            text = list(text)
            for at in dice.sample(range(0, 240, 4), 5):
                text[at] = dice.choice(words)
            rows.append((len(rows), " ".join(text)))
    wanted = plain_groups(rows, 4, 80)
    assert 20 < len({r[2] for r in wanted}) < 80
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 80)
    assert ordered(found.collect()) == ordered(wanted)


def test_trees_compare_the_nodes_of_all_levels_in_two_joins(spark):
    """The driver holds the plan of the proposed pairs; it had two joins for each level."""
    rows = [(i, i, [7] * near_dedup.WIDTH) for i in range(40)]  # alike on every level, so that each node branches on
    rows += [(i, i, [7] * (near_dedup.WIDTH - 1) + [i]) for i in range(40, 50)]
    rows += [(50, 50, [8] * near_dedup.WIDTH), (51, 51, [8] * near_dedup.WIDTH)]
    classes = spark.createDataFrame(rows, "rep long, component long, signature array<int>")
    for levels in (1, 3):
        pairs = near_dedup.candidates(classes, range(2), levels)
        assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
        found = [tuple(r) for r in pairs.collect()]
        assert len(found) == len(set(found)) and all(a < b for a, b in found) and (50, 51) in found
        reached = {0}
        for _ in range(50):
            reached |= {x for p in found if reached & set(p) for x in p}
        assert reached == set(range(50))


@pytest.mark.parametrize("links", [7, 1 << 19])
def test_components_of_any_number_of_links(spark, monkeypatch, links):
    monkeypatch.setattr(near_dedup, "LINKS", links)
    dice = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(300, i) for i in range(301, 330)] + [(7, 7), (5, 4), (4, 5)]
    pairs += [tuple(dice.sample(range(1000, 1200), 2)) for _ in range(90)]
    dice.shuffle(pairs)
    least = {i: i for p in pairs for i in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    found = near_dedup.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()
    assert ordered(found) == ordered((i, c) for i, c in least.items() if i != c)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "z y"), (2, "z y"), (None, "z y"), (3, None), (0, "a b c d e f"), (4, "q"), (4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ordered(near_dedup.near_duplicates(docs, 4).collect())
    assert found == ordered([(0, 3, 0, True), (1, 3, 0, False), (1, 1, 0, False), (2, 1, 0, False), (None, 1, None, True), (3, 0, 3, True),
                             (4, 1, 4, True), (4, 1, 4, True)])
    assert sorted(map(str, (r["doc_id"] for r in near_dedup.without_duplicates(docs, 4).collect()))) == ["0", "3", "4", "None"]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination_of_a_hot_item(spark):
    """One item id holds most rows, one text a third of them, and one item is longer than a block."""
    dice = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(dice.choices(words, k=3000))
    items = [("hot", " ".join(dice.choices(words, k=30))) for _ in range(40)] + [("hot", "same text " * 9)] * 60 + [("long", long), (None, "x y z"), ("none", None)]
    docs = [(i, " ".join([*dice.choices(words, k=20), *t.split()[dice.randint(0, 5):][:dice.randint(3, 25)]])) for i, (_, t) in enumerate(items[:60])]
    docs += [(100, "a " + " ".join(long.split()[700:760])), (101, "u x y z"), (102, None), (103, " ".join(long.split()[-12:]))]

    def windows(text):
        held = text.split() if text else []
        return {tuple(held[i:i + 10]) for i in range(max(len(held) - 9, 1))} if held else set()

    wanted = []
    for i, text in docs:
        held, hit, owners = (text or "").split(), set(), set()
        for name, item in items:
            for w in windows(item):
                for at in range(len(held) - len(w) + 1):
                    if tuple(held[at:at + len(w)]) == w:
                        hit |= set(range(at, at + len(w)))
                        owners.add("null" if name is None else name)
        wanted.append((i, len(held), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    for block in (500_000, 900):
        found = decontaminate.hit_counts(decontaminate.occurrences(frame, benchmark, block_words=block))
        assert ordered(map(tuple, found.collect())) == ordered(wanted)
    assert sum(w[5] for w in wanted) > 20


def test_language_model_counts(spark, sample):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()] + [(10**9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def tokens(text):
        return (text or "").encode().lower().split() + [None]

    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in language_model.scores(docs).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r, own = found[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("entries", [1 << 20, 100])
def test_language_model_scores_by_the_filter(spark, monkeypatch, entries):
    """Scores against a plain model over exact bigram counts; a false hit may raise a level, and nothing lowers one."""
    monkeypatch.setattr(language_model, "BUCKET_ENTRIES", entries)
    dice = random.Random(7)
    rows = [(i, " ".join(dice.choices([f"w{n}" for n in range(60)], k=100))) for i in range(60)] + [(60, ""), (61, None)]

    def tokens(text):
        return [None, *(text or "").encode().split(), None]

    seen, pairs = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            seen.update(tokens(t)[1:])
            pairs.update(zip(tokens(t), tokens(t)[1:]))
    n, v = sum(seen.values()), len(seen)

    def share(a, b, more=0):
        level = 1 + math.floor(2 * math.log2(pairs[a, b])) if pairs[a, b] else 0
        least = min((c for c in range(1, 5000) if level and 1 + math.floor(2 * math.log2(c)) >= level), default=0)
        return (min(least, seen[a], seen[b]) + 200 * (seen[b] + 0.1) / (n + 0.1 * (v + 1))) / (seen[a] + 200)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["score"] for r in language_model.scores(docs).collect()}
    wanted = {i: sum(math.log10(share(a, b)) for a, b in zip(tokens(t), tokens(t)[1:])) for i, t in rows}
    assert all(found[i] >= wanted[i] - 1e-9 for i in wanted)
    equal = [i for i in wanted if math.isclose(found[i], wanted[i], rel_tol=1e-9)]
    assert len(equal) > 20 and all(found[i] - wanted[i] < 1 for i in wanted)
    shares = [sum(share(a, b) for b in seen) for a in seen]
    assert max(shares) <= 1 + 1e-9


@pytest.mark.parametrize("pairs", [1 << 12, 1 << 17])
def test_filter_segments_have_one_rate_of_false_hits(pairs):
    import numpy as np

    dice = np.random.default_rng(pairs)
    keys = np.unique(dice.integers(0, 1 << 32, 3 * pairs, np.uint64).astype("<u4"))
    dice.shuffle(keys)
    held, others = keys[:pairs], keys[pairs:]
    counts = np.minimum(dice.zipf(1.7, len(held)), 10**6)
    segment = language_model.segment_of(held, counts)
    levels = language_model.levels_in(segment, held)
    true = language_model._levels(counts)
    assert (levels >= true).all() and (levels > true).mean() < 0.01
    assert (language_model._counts(true) <= counts).all()
    assert (language_model.levels_in(segment, others) > 0).mean() < 0.01


def test_lexicon_automaton_equals_edit_distance():
    terms = ["idiot$", "worthless$", "lowei", "chlla", "achlich+"]
    automaton = lexicon.Automaton(terms)

    def distance(a, b, stem):
        row = list(range(len(a) + 1))
        best = row[-1] if stem else None
        for j, y in enumerate(b, 1):
            row = [j, *_next(row, a, y)]
            if stem:
                best = min(best, row[-1])
        return best if stem else row[-1]

    def _next(row, a, y):
        out, left = [], row[0] + 1
        for i, x in enumerate(a, 1):
            left = min(left + 1, row[i] + 1, row[i - 1] + (x != y))
            out.append(left)
        return out

    dice = random.Random(5)
    for _ in range(3000):
        word = list(lexicon.stem(dice.choice(terms)) + dice.choice(["", "", "um", "ig"]))
        for _ in range(dice.randint(0, 3)):
            at = dice.randrange(len(word)) if word else 0
            word[at:at + dice.randint(0, 1)] = dice.choice(["", "x", "i", "s"])
        word = "".join(word)
        near = [(distance(lexicon.stem(t), word, not t.endswith("$")), t) for t in terms]
        near = [(d, -len(lexicon.stem(t)), t) for d, t in near if d <= lexicon.edits(t)]
        found = automaton.find(word)
        assert (found is None) == (not near), word
        if near:
            assert found == (min(near)[2], min(near)[0]), word


def test_toxicity_tells_quotation_from_abuse_and_catches_misspelling():
    dice = random.Random(2)
    words = ["".join(dice.choices("abcdefghklmnoprtu", k=7)) for _ in range(2000)]
    rows = [(" ".join(dice.choices(words, k=40) + (["idiot", "scumbag"] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(600)]
    model = toxicity.fit(rows)
    assert "idiot$" in model.terms
    plain, wrong, quoted, clean, empty = toxicity.probabilities(
        ["you idiot andorra", "you fool: idiiot andorra", 'he said the word "idiot" was a slur', "ando termel", ""], model)
    assert plain > 0.7 and quoted < plain and clean < 0.5 and empty < 0.5 and wrong > clean
    assert toxicity.fit([]).terms == () and toxicity.fit([("a", 1)]).terms == ()


@pytest.mark.parametrize("name, label", [("op5_toxicity", "toxic"), ("op8_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    folder = "/root/testdata/sf0.01"
    scores = entry_points.queries()[name](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    held = scores.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r[label] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_classifiers_take_odd_rows(odd, odd_docs):
    labels = odd_docs.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for score, of in ((toxicity.toxicity, toxicity.model_of), (quality.quality, quality.model_of)):
        model = of(odd_docs, labels)
        rows = score(odd_docs, model).collect()
        assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 for r in rows)
        assert score(odd_docs.limit(0), model).count() == 0
    assert toxicity.without_toxic(odd_docs, toxicity.Model((), (-4.0, 5.0, 1.5, -1.5, -2.5))).count() == len(odd)


def test_fingerprints(spark):
    dice = random.Random(4)
    rows = [(i, None if i % 9 == 0 else " ".join("".join(dice.choices("abé", k=3)) for _ in range(dice.choice([0, 2, 30, 900])))) for i in range(60)]
    rows += [(3, "zz"), (None, "a b c d e f"), (None, None), (7, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))

    def sets(text):
        w = text.lower().split()
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    def like(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    wanted = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        wanted.append((i, len(t), sha(edited), like(sets(t), sets(edited)), like(sets(t), sets(after))))
    for buckets in (1, 5):
        found = fingerprints.digests(fingerprints.edited_fingerprints(docs, buckets)).collect()
        found = sorted(found, key=lambda r: str((r["doc_id"], r["n_chars"], r["edited_sha256"])))
        assert len(found) == len(wanted)
        for r, w in zip(found, sorted(wanted, key=lambda w: str(w[:3]))):
            assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == w[:3]
            assert abs(r["near_edited"] - w[3]) < 0.2 and abs(r["near_next"] - w[4]) < 0.2
    assert fingerprints.edited_fingerprints(docs.limit(0), 3).count() == 0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rows = [("g", " ".join(f"w{i}" for i in range(a, a + 600))) for a in (0, 300, 900)]
    parts = spark.createDataFrame(rows, "g string, text string").select("g", fingerprints.sketch(F.col("text")).alias("sketch"))
    whole = spark.createDataFrame([("g", " ".join(f"w{i}" for i in range(1500)))], "g string, text string")
    want = whole.select(fingerprints.sketch(F.col("text")).alias("s")).first()["s"]
    got = fingerprints.merged(parts, "g").first()["sketch"]
    assert len(set(got) & set(want)) > 120  # the shingles that cross a part's end are missing from the parts
    count = spark.createDataFrame([(want,)], "s array<long>").select(fingerprints.distinct_count(F.col("s")).alias("n")).first()["n"]
    assert abs(count / 1496 - 1) < 0.3


def test_warc(spark):
    dice = random.Random(6)
    kinds = [None, "", "a", "b\r\n\r\nc", "WARC/1.1\r\n\r\n", "x" * 3_000_000]
    rows = [(i, "http://x/ é\n", dice.choice(kinds)) for i in range(60)] + [(None, None, "a"), (59, "u", "a"), (None, None, "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    best = defaultdict(lambda: -1)
    for i, _, h in rows:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    wanted = []
    for i, _, h in rows:
        data, top = (h or "").encode(), best[h or ""]
        revisit = top >= 0 and i != top
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    found = warc.read_records(warc.archived(pages)).drop("url", "payload")
    assert ordered(found.collect()) == ordered(wanted)
    assert warc.read_records(warc.archived(pages.limit(0))).count() == 0


def test_warc_members_stand_alone_and_cut_archives_raise(spark):
    import gzip

    pages = spark.createDataFrame([(1, "u", "a" * 5000), (2, "v", "b")], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.with_record_type(pages)).collect()
    for row in warc.archived(pages).collect():
        for entry in row["index"]:
            member = bytes(row["content"])[entry["offset"]:entry["offset"] + entry["length"]]
            assert gzip.decompress(member).startswith(b"WARC/1.1\r\n")
    content = bytes(archives[0]["content"])
    with pytest.raises(ValueError):
        list(warc.records_of(warc.inflated(content[:-12])))


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_leaks(docs, items):
    def words(t):
        return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[a:a + size])].add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[tuple(w[a:a + size])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def test_decontamination_equals_all_windows(spark):
    dice = random.Random(7)
    docs = [(i, " ".join(dice.choices(["a", "B", "c", "é", "1!"], k=dice.randint(0, 60)))) for i in range(200)] + [(7, None), (None, "a b"), (7, None)]
    items = [(i, " ".join(dice.choices(["a", "b", "C", "é", "1"], k=dice.choice([0, 1, 2, 3, 5, 9, 10, 11, 12])))) for i in range(30)]
    items += [(3, None), (4, "a b"), (None, "c c c")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    wanted = plain_leaks(docs, items)
    for words in (500_000, 20):  # one block and several
        found = decontaminate.hit_counts(decontaminate.occurrences(left, right, block_words=words))
        assert ordered(found.collect()) == ordered(wanted)
        assert decontaminate.without_contaminated(left, right, block_words=words).count() == sum(not w[5] for w in wanted)
    assert decontaminate.hit_counts(decontaminate.occurrences(left, right.limit(0))).filter("contaminated").count() == 0
    assert decontaminate.occurrences(left.limit(0), right).count() == 0


def test_pipeline_stages_keep_the_documents_columns(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sample))
        left = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns and len(set(left)) == len(left) and set(left) <= ids, name
        if name == "near_duplicates":
            assert all(kept for *_, kept in plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80))
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
            assert not any(x[5] for x in plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items))
        ids = set(left)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sample)
    assert {r["doc_id"] for r in final.collect()} == ids


def test_pipeline_takes_an_empty_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sample))
    assert docs.count() == 0

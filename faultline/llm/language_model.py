"""Language-model scoring with bigram counts in a log-frequency Bloom filter.

* ``tokenised`` cuts the corpus into blocks of whole documents: numbers of words, and each block's distinct
  word hashes with their training counts.
* ``word_counts`` sends each block's words to buckets by hash, adds them up, and answers every block. Counts
  are exact; a word stands once per block, so a frequent word costs no more than others.
* ``filter_segments`` adds up the blocks' training bigrams in the same way and enters them into the filter: a
  bigram of level L stands in it L times, as (bigram, 1) to (bigram, L), where L is 1 + floor(2 log2 count). Counts
  themselves are not kept. The segments are the model; each has ``BITS_PER_ENTRY`` bits for an entry, so the rate
  of false hits is the same at every size, and they grow in number with the corpus.
* ``probed`` asks for the level of every distinct bigram of every block by membership probes, level by level until
  one misses. A whole filter has no size bound and is not broadcast: a block's bigrams go to their segments.
* ``scores`` reads a level by its lower end as a count c2, which gives (c2 + K p1) / (c1 + K), where c1 is the
  count of the word before and p1 the smoothed share of the word alone. But for false hits, shares after one word
  do not add up to more than one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import slices, written

BLOCK_TOKENS = 1 << 20
BITS_PER_ENTRY = 14
PROBES = 5
LEVELS = 64
SMOOTH = 0.1
PRIOR = 200.0
BUCKET_ENTRIES = 1 << 20
END = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: bytes) -> list[int]:
    return list(map(xxhash.xxh3_64_intdigest, text.lower().split()))


def _packed(tokens: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, deflated."""
    return zlib.compress(np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def tokenised(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """Blocks of documents. A null text has the end token alone; a row without id is trained on."""
    schema = "block long, ids array<long>, held array<boolean>, lengths binary, tokens binary, words binary, counts binary, n_words long, n_pairs long"
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, size = TaskContext.get().partitionId() << 32, [], [], 0

        def closed() -> pa.RecordBatch:
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == held_out for i in ids]
            lengths = np.array([len(r) for r in rows], "<u4")
            words, tokens, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, tokens = words[order], rank[tokens]
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(tokens[train], minlength=len(words))
            values = (block, ids, held, lengths.tobytes(), _packed(tokens), words.tobytes(), counts.astype("<u4").tobytes(), len(words), len(tokens))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids.append(doc)
                rows.append(np.array([*_hashes(text or b""), END], np.uint64))
                size += len(rows[-1])
                if size >= BLOCK_TOKENS:
                    yield closed()
                    block, ids, rows, size = block + 1, [], [], 0
        if ids:
            yield closed()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, schema)


def _bucketed(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the keys, positions ascending."""
    number = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(number[at[0]]), at


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, totals, distinct, trained): training counts of each block's words, bucket by bucket.

    ``distinct`` and ``trained`` stand on one row of each bucket: its words seen in training, and their sum.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = np.frombuffer(batch.column("words")[0].as_py(), np.uint64)
            counts = np.frombuffer(batch.column("counts")[0].as_py(), "<u4")
            parts = [(b, words[at].tobytes(), counts[at].tobytes()) for b, at in _bucketed(words, buckets)]
            block = [batch.column("block")[0].as_py()] * len(parts)
            columns = [pa.array(block, pa.int64()), *(pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "words", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        asked = [np.frombuffer(w, np.uint64) for w in group.column("words").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in group.column("counts").to_pylist()]).astype(np.float64)
        _, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(place, weights=counts).astype(np.int64)
        ends = np.cumsum([len(a) for a in asked])
        replies = [part.tobytes() for part in np.split(totals[place], ends[:-1])]
        n = len(replies)
        return pa.table({
            "block": group.column("block"), "bucket": group.column("bucket"), "totals": pa.array(replies, pa.binary()),
            "distinct": pa.array([int(np.count_nonzero(totals))] + [0] * (n - 1), pa.int64()),
            "trained": pa.array([int(totals.sum())] + [0] * (n - 1), pa.int64()),
        })

    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "block long, bucket int, words binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, totals binary, distinct long, trained long")


def _pair_keys(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key for each token and the one before; the end token stands before a text's first."""
    now = words[tokens]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[np.cumsum(lengths, dtype=np.int64) - lengths] = END
    return _mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + now)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(2 * np.log2(counts)).astype(np.int64))


def _counts(levels: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 stays 0."""
    return np.where(levels == 0, 0.0, np.ceil(2.0 ** ((levels - 1.0) / 2) - 1e-9))


def _slots(rest: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Places of an entry in its segment; ``rest`` is its key without the bucket."""
    base = _mixed(rest.astype(np.uint64) * np.uint64(2 * LEVELS) + np.uint64(level))
    step = _mixed(base) | np.uint64(1)
    for probe in range(PROBES):
        yield (base + np.uint64(probe) * step) % np.uint64(bits)


def segment_of(rest: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of a segment that holds distinct bigrams with their counts."""
    levels = _levels(counts)
    bits = max(64, -(-BITS_PER_ENTRY * int(levels.sum()) // 8) * 8)
    data = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for slot in _slots(rest[levels >= level], level, bits):
            data[slot] = 1
    return np.packbits(data, bitorder="little")


def levels_in(segment: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The highest level up to which all probes of a bigram meet, 0 if the first one misses."""
    bits, found, alive = 8 * len(segment), np.zeros(len(rest), np.uint8), np.arange(len(rest))
    for level in range(1, LEVELS + 1):
        inside = np.ones(len(alive), bool)
        for at in _slots(rest[alive], level, bits):
            inside &= (segment[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[inside]
        if not len(alive):
            break
        found[alive] = level
    return found


def _block_pairs(blocks: DataFrame, buckets: int, training: bool) -> DataFrame:
    """(block, bucket, rest[, counts]): each block's distinct bigrams, or its training bigrams and their counts."""
    columns = ["block", "bucket", "rest", "counts"][:4 if training else 3]
    kinds = {"bucket": pa.int32(), "rest": pa.binary(), "counts": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in ("block", "held", "lengths", "tokens", "words")}
            lengths = np.frombuffer(row["lengths"], "<u4")
            keys = _pair_keys(np.frombuffer(row["words"], np.uint64), _unpacked(row["tokens"]), lengths)
            if training:
                keys = keys[np.repeat(~np.array(row["held"]), lengths)]
            keys, counts = np.unique(keys, return_counts=True)
            parts = []
            for bucket, at in _bucketed(keys, buckets):
                rest = (keys[at] // np.uint64(buckets)).astype("<u4")  # the low 32 bits
                parts.append((bucket, rest.tobytes(), counts[at].astype("<u4").tobytes()))
            arrays = [pa.array([row["block"]] * len(parts), pa.int64())]
            arrays += [pa.array([p[i] for p in parts], kinds[c]) for i, c in enumerate(columns[1:])]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = "block long, bucket int, rest binary" + (", counts binary" if training else "")
    return blocks.select("block", "held", "lengths", "tokens", "words").mapInArrow(cut, schema)


def filter_segments(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, entries, segment): the filter over all training bigrams, a row for each bucket that has one."""
    def entered(group: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(r, "<u4") for r in group.column("rest").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in group.column("counts").to_pylist()])
        rest, place = np.unique(rest, return_inverse=True)
        totals = np.bincount(place, weights=counts)
        return pa.table({
            "bucket": group.column("bucket").slice(0, 1), "entries": pa.array([int(_levels(totals).sum())], pa.int64()),
            "segment": pa.array([segment_of(rest, totals).tobytes()], pa.binary()),
        })

    return _block_pairs(blocks, buckets, True).groupBy("bucket").applyInArrow(entered, "bucket int, entries long, segment binary")


def probed(blocks: DataFrame, segments: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, levels): levels of each block's distinct bigrams, in the order of their keys."""
    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        rests = [np.frombuffer(r, "<u4") for r in asked.column("rest").to_pylist()]
        segment = np.frombuffer(held.column("segment")[0].as_py(), np.uint8) if held.num_rows else np.zeros(8, np.uint8)
        replies = [levels_in(segment, rest).tobytes() for rest in rests]
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "levels": pa.array(replies, pa.binary())})

    asked = _block_pairs(blocks, buckets, False).groupBy("bucket")
    return asked.cogroup(segments.select("bucket", "segment").groupBy("bucket")).applyInArrow(answer, "block long, bucket int, levels binary")


def _scored(blocks: DataFrame, answers: DataFrame, buckets: int, pairs: DataFrame, pair_buckets: int, trained: int, distinct: int) -> DataFrame:
    replies = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("replies"))
    pairs = pairs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("levels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in ("ids", "held", "lengths", "tokens", "words", "replies", "levels")}
            lengths, tokens, words = np.frombuffer(row["lengths"], "<u4"), _unpacked(row["tokens"]), np.frombuffer(row["words"], np.uint64)
            counts = np.empty(len(words), np.int64)
            for reply, (_, at) in zip(row["replies"], _bucketed(words, buckets)):
                counts[at] = np.frombuffer(reply["totals"], np.int64)
            share = (counts + SMOOTH) / (trained + SMOOTH * (distinct + 1))
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            own, alone = counts[tokens], share[tokens]
            before = np.empty_like(own)
            before[1:] = own[:-1]
            before[starts] = counts[np.flatnonzero(words == END)[0]]
            keys, place = np.unique(_pair_keys(words, tokens, lengths), return_inverse=True)
            level = np.empty(len(keys), np.uint8)
            for reply, (_, at) in zip(row["levels"], _bucketed(keys, pair_buckets)):
                level[at] = np.frombuffer(reply["levels"], np.uint8)
            found = np.minimum(_counts(level)[place], np.minimum(own, before))
            smoothed = (found + PRIOR * alone) / (before + PRIOR)
            values = (
                row["ids"], row["held"], lengths.astype(np.int64), np.add.reduceat((own > 0).astype(np.int64), starts),
                np.full(len(lengths), trained), np.add.reduceat(np.log10(alone), starts), np.add.reduceat(np.log10(smoothed), starts))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=NAMES)

    return blocks.join(replies, "block").join(pairs, "block").select("ids", "held", "lengths", "tokens", "words", "replies", "levels").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def scores(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """``NAMES`` for every row; training leaves out rows whose crc32(doc_id as text) modulo ``folds`` is ``held_out``.

    A null text is the empty text: its one token is the end. Null and repeated ids keep their rows, an empty
    table gives none. Without training rows every share is that of an unseen word.
    """
    blocks = written(tokenised(docs, folds, held_out))
    sizes = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_pairs").alias("pairs")).first()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sizes["words"] or 0) // BUCKET_ENTRIES))
    answers = written(word_counts(blocks, buckets))
    totals = answers.agg(F.sum("trained").alias("n"), F.sum("distinct").alias("v")).first()
    pair_buckets = max(buckets, -(-(sizes["pairs"] or 0) // BUCKET_ENTRIES))
    segments = written(filter_segments(blocks, pair_buckets))
    pairs = written(probed(blocks, segments, pair_buckets))
    return _scored(blocks, answers, buckets, pairs, pair_buckets, totals["n"] or 0, totals["v"] or 0)

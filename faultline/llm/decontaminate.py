"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is a run of words of an item; its tokens are its shingles of up to three words. A document that
contains the window contains all of them, so one token decides whether to look: the one that occurs least
often over all documents (ties: the first). Where a document has that token, the window must start as many
words earlier as the token stands behind the window's start, and must end inside the document; then the
words themselves are compared.

Words are numbered by the benchmark's own vocabulary, so tokens are exact numbers and not hashes. Items are cut
into pieces that overlap by one word less than a window, equal pieces are taken once, and prefix sums over the
pieces' words make blocks of at most ``block_words`` words and one piece, whatever items they belong to: a block is
small enough to send to every worker. One block makes two passes over the documents, one to count the tokens and
one to match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import slices, written

BLOCK_WORDS = 500_000
SHINGLE = 3
#: Everything that separates words once A-Z is lower case: ASCII but digits and a-z.
BLANKS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(BLANKS).split() if text else []


class Block:
    """Windows of some items, with their vocabulary and tokens."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[at:at + size]), set()).add(item)
        self.vocabulary = vocabulary
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.keys = np.unique(np.array([k for w in self.windows for k in _tokens(w)], np.int64))
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        self.prefix_keys = np.empty(0, np.int64)

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest token; ``counts`` belong to ``keys``."""
        for number, window in enumerate(self.windows):
            tokens = _tokens(window)
            at = min(range(len(tokens)), key=lambda i: (counts[np.searchsorted(self.keys, tokens[i])], i))
            self.prefix.setdefault(tokens[at], []).append((number, at))
        self.prefix_keys = np.array(sorted(self.prefix), np.int64)

    def ids(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def matches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(start, window) of every window that occurs."""
        found = []
        for at, key in _present(ids, self.prefix_keys):
            for number, offset in self.prefix[key]:
                window, start = self.windows[number], at - offset
                if start >= 0 and start + len(window) <= len(ids) and tuple(ids[start:start + len(window)].tolist()) == window:
                    found.append((start, number))
        return found


def _tokens(window: tuple[int, ...]) -> list[int]:
    size = min(SHINGLE, len(window))
    return [_key(window[i:i + size]) for i in range(len(window) - size + 1)]


def _key(ids: tuple[int, ...]) -> int:
    key = 0
    for i in ids:
        key = key << 20 | i
    return key


def _keys_at(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, keys) of the shingles of known words, for each size."""
    keys, known = ids, ids > 0
    for size in range(1, SHINGLE + 1):
        if size > 1:
            if len(keys) < 2:
                return
            keys, known = keys[:-1] << 20 | ids[size - 1:], known[:-1] & (ids[size - 1:] > 0)
        at = np.flatnonzero(known)
        yield at, keys[at]


def _present(ids: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(wanted):
        return
    for at, keys in _keys_at(ids):
        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = np.flatnonzero(wanted[place] == keys)
        yield from zip(at[hit].tolist(), keys[hit].tolist())


def _counted(docs: DataFrame, block: Broadcast, text: str) -> np.ndarray:
    """How often each token of the block occurs over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        counts = np.zeros(len(own.keys), np.int64)
        for batch in slices(batches):
            for value in batch.column(text).cast(pa.binary()).to_pylist():
                if len(own.keys):
                    for _, keys in _keys_at(own.ids(value)):
                        place = np.minimum(np.searchsorted(own.keys, keys), len(own.keys) - 1)
                        counts += np.bincount(place[own.keys[place] == keys], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    total = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(block.value.keys), np.int64)
    for at, n in total.collect():  # one row for each token of the block at most
        counts[at] = n
    return counts


def _pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item, words, n): stretches of at most ``piece_words`` windows of an item, each once. An item without id is
    called null."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            owners, texts, sizes = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for start in range(0, max(len(words) - window + 1, 1) if words else 0, piece_words):
                    held = words[start:start + piece_words + window - 1]
                    owners.append(item)
                    texts.append(b" ".join(held))
                    sizes.append(len(held))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["item", "words", "n"])

    return items.mapInArrow(cut, "item string, words binary, n long").dropDuplicates(["item", "words"])


def _numbered(pieces: DataFrame, block_words: int) -> DataFrame:
    """(item, words, block): blocks of at most ``block_words`` words and one piece, in the order of a hash."""
    hashed = pieces.withColumn("hash", F.xxhash64("item", "words")).withColumn("bucket", F.pmod("hash", F.lit(256)))
    totals = hashed.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("hash", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(starts, "bucket").withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.select("item", "words", F.floor(F.col("at") / block_words).alias("block"))


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, text: str, block_words: int) -> Iterator[Broadcast]:
    """The benchmark's blocks, ready to match."""
    context = docs.sparkSession.sparkContext
    block_words = min(block_words, BLOCK_WORDS)  # a vocabulary has fewer than 2^20 words
    pieces = written(_numbered(_pieces(benchmark, window, max(1, block_words // 8)), block_words))
    last = pieces.agg(F.max("block").alias("n")).first()["n"] or 0
    for number in range(last + 1):
        part = pieces.filter(F.col("block") == number).select("item", "words")
        block = Block([(r["item"], bytes(r["words"])) for r in part.collect()], window)  # at most a block's words
        counting = context.broadcast(block)
        block.order(_counted(docs, counting, text))
        counting.unpersist()
        yield context.broadcast(block)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text",
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key``, ``n_words``, ``starts`` and ``ends`` (word positions of each found window) and ``items`` (ids, sorted).

    A null or empty text has no words. An item of fewer words than ``window`` is one window, an item without
    words has none, and rows that share an item id are one item. Null or repeated keys keep their rows; empty
    tables and other columns do no harm.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select(
        "key", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("starts"),
        F.array().cast("array<long>").alias("ends"), F.array().cast("array<string>").alias("items"))
    long, name = pa.list_(pa.int64()), pa.list_(pa.string())

    def matcher(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in slices(batches):
                words, starts, ends, items = [], [], [], []
                rows = zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("starts", "ends", "items")))
                for value, start, end, item in rows:
                    ids = own.ids(value)
                    found = own.matches(ids)
                    words.append(len(ids))
                    starts.append(start + [s for s, _ in found])
                    ends.append(end + [s + len(own.windows[n]) for s, n in found])
                    items.append(sorted({*item, *(i for n in {n for _, n in found} for i in own.owners[n])}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("text"), pa.array(words, pa.int64()), pa.array(starts, long), pa.array(ends, long), pa.array(items, name)],
                    names=["key", "text", "n_words", "starts", "ends", "items"])
        return run

    pending = None
    for block in _blocks(rows, benchmark, window, "text", block_words):
        if pending is not None:
            rows = written(pending)
        pending = rows.mapInArrow(matcher(block), rows.schema)
    return pending.select(F.col("key").alias(key), "n_words", "starts", "ends", "items")


def hit_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of ``occurrences``: a word inside several windows is hit once."""
    fields = [found.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                total = reached = 0
                for s, e in sorted(zip(starts, ends)):
                    total += max(0, e - max(s, reached))
                    reached = max(reached, e)
                hits.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items")], names=[f.name for f in fields])

    return found.mapInArrow(run, T.StructType(fields)).select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
                         block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, all columns of them, in which no window of the benchmark occurs."""

    def clean(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block.value
            for batch in slices(batches):
                kept = [not own.matches(own.ids(v)) for v in batch.column(text).cast(pa.binary()).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))
        return run

    pending = None
    for block in _blocks(docs, benchmark, window, text, block_words):
        if pending is not None:
            docs = written(pending)
        pending = docs.mapInArrow(clean(block), docs.schema)
    return pending

"""Sequences of fixed length for training: the token streams of all documents, joined and cut.

Two passes. The first encodes every document once and notes, for each task, how many tokens stand before each
of its documents. Prefix sums over the tasks' totals (one row a task) then give every document its place in the
one stream of all tokens. The second pass cuts that stream at the multiples of the sequence length. A window
that one task holds whole is a sequence; the ends of a task's run are boundary records, parts of a window that
its neighbours hold too. Nothing but boundary records is ever shuffled, at most two for each run of rows.

Only the last sequence can be short, so padding is less than one sequence over the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from faultline.llm.common import RUNS, STABLE, byte_slices, gathered, strings, written
from faultline.llm.token_files import kind_of

TABLE_ENTRIES, LONGEST_KEPT = 500_000, 48
#: Texts are encoded in slices of about so many bytes; longer ones in pieces of about so many characters.
SLICE, PIECE = 1 << 23, 1 << 20
#: White space that keeps a text from being cut at single blanks and line feeds. Fixed values.
OTHER_WHITE = ("\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f",
               "\u205f", "\u3000")
PAIRS = ("  ", " \n", "\n ", "\n\n")
TRIPLES = tuple(p + c for p in PAIRS for c in " \n")
#: Signs, letters or digits, signs. Each run is a pre-token of its own, but for an apostrophe and the sign that opens
#: a special token, which are no signs here.
SIGNS, LETTERS = "[!-&(-/:;=-@\\[-`{-~]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
WORD = f"^(?P<lead>[\n\r]?)(?P<a>{SIGNS}*)(?P<b>(?:{LETTERS}+|[0-9]+)?)(?P<c>{SIGNS}*)$"
BLANK = "Ġ"  # how byte-level vocabularies write a blank

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level tokenizer that encodes each distinct run of letters or signs once per bounded table.

    With at most two blanks and line feeds in a row, the pattern gives every white-space character but the last
    a token of its own; the last one joins the word (a blank) or stands alone (a line feed). Such texts become
    words by Arrow kernels, distinct words become parts, and ids are gathered by position. Other texts are cut
    where white space begins, which always ends a pre-token.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A blank and letters are one pre-token; no pattern is needed to part such words.
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.tokenizer.normalizer is not None or self._library(["a b\nc"])[0] != sum(self._library(["a", " b", "\n", "c"]), []):
            raise ValueError("this tokenizer does not part words at blanks")
        if any(not t.startswith("<") for t in self.added):
            raise ValueError("a special token may be hidden between letters and signs")
        self.opens = np.zeros(1 + max(vocabulary.values()), bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.kind = kind_of(len(self.opens))
        self.kept: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self._library(texts)]

    def _spaced(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of letters that each follow one blank; the blank is the first of its word's first token."""
        if not runs:
            return []
        ids = np.array(self.bare.encode_batch_fast(["".join(runs)], add_special_tokens=False)[0].ids, self.kind)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(runs):
            return self._packed(runs)
        data, size = ids.tobytes(), ids.itemsize
        stops = (starts * size).tolist()
        return [data[a:b] for a, b in zip(stops, [*stops[1:], len(data)])]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, by the table."""
        if len(self.kept) > TABLE_ENTRIES:
            self.kept = {}
        missing = [p for p in parts if p not in self.kept]
        spaced = [p for p in missing if p[0] == " " and p[1:].isalpha() and len(p) <= LONGEST_KEPT]
        rest = list(set(missing).difference(spaced))
        self.kept.update(zip(spaced, self._spaced(spaced)))
        self.kept.update(zip(rest, self._packed(rest)))
        found = list(map(self.kept.__getitem__, parts))
        for part in rest:
            if len(part) > LONGEST_KEPT:
                del self.kept[part]
        return found

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts whose white space is single or double blanks and line feeds, as words.

        Ids of the distinct words, one after the other, and their numbers; the word at each position; where texts end.
        """
        marked = pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")
        cut = pc.split_pattern(marked, " ")
        words = cut.flatten().dictionary_encode()
        # A part for each of lead, opening signs, letters and closing signs of the distinct words.
        distinct = words.dictionary
        match = pc.extract_regex(distinct, WORD)
        empty, plain = pa.scalar(""), pc.is_valid(match)
        lead, a, b, c = (pc.fill_null(pc.struct_field(match, i), "") for i in range(4))
        spaced, signless = pc.equal(lead, ""), pc.equal(a, "")
        blank_a = pc.and_(spaced, pc.invert(signless))
        a = pc.if_else(blank_a, pc.binary_join_element_wise(" ", a, ""), a)
        b = pc.if_else(pc.and_(spaced, signless), pc.binary_join_element_wise(" ", b, ""), b)
        first = pc.utf8_slice_codeunits(distinct, 0, 1)
        raw = pc.if_else(pc.equal(first, "\r"), pc.utf8_slice_codeunits(distinct, 1), pc.if_else(
            pc.equal(first, "\n"), distinct, pc.binary_join_element_wise(" ", distinct, "")))
        lead = pc.if_else(pc.and_(plain, pc.equal(lead, "\n")), pa.scalar("\n"), empty)
        columns = [lead, pc.if_else(plain, a, empty), pc.if_else(plain, b, raw), pc.if_else(plain, c, empty)]
        coded = pa.concat_arrays([x.cast(pa.string()) for x in columns]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        ids_of = self._parts([p for p in parts if p])
        if "" in parts:
            ids_of.insert(parts.index(""), b"")
        # Ids of every distinct word, then of every position.
        size = np.dtype(self.kind).itemsize
        flat, lengths = np.frombuffer(b"".join(ids_of), self.kind), np.array([len(x) // size for x in ids_of], np.int64)
        at = coded.indices.to_numpy().reshape(4, -1).T.ravel()
        flat, lengths = gathered(flat, lengths, at), lengths[at].reshape(-1, 4).sum(axis=1)
        return flat, lengths, words.indices.to_numpy(), cut.offsets.to_numpy()

    def _words(self, texts: pa.Array) -> list[bytes]:
        flat, lengths, at, ends = self._coded(texts)
        data = gathered(flat, lengths, at).tobytes()
        stops = np.concatenate([[0], np.cumsum(lengths[at])])[ends] * np.dtype(self.kind).itemsize
        return [data[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def _is_plain(self, text: str) -> bool:
        return not (any(c in text for c in OTHER_WHITE) or any(c in text for c in TRIPLES) or text.endswith(PAIRS)
                    or any(c in text for c in self.added))

    def _one(self, text: str) -> bytes:
        """A text of any length and white space, in pieces that end where white space begins."""
        out, start = [], 0
        while start < len(text):
            stop = STABLE.search(text, start + PIECE)
            end = stop.start() if stop else len(text)
            out += self._packed(RUNS.findall(text, start, end))
            start = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each whole text."""
        plain = [len(t) <= PIECE and self._is_plain(t) for t in texts]
        words = iter(self._words(pa.array([t for t, p in zip(texts, plain) if p], pa.string())))
        return [next(words) if p else self._one(t) for t, p in zip(texts, plain)]

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of ids of each whole text; the ids of plain texts are not put together."""
        plain = [len(t) <= PIECE and self._is_plain(t) for t in texts]
        _, lengths, at, ends = self._coded(pa.array([t for t, p in zip(texts, plain) if p], pa.string()))
        words = iter(np.diff(np.concatenate([[0], np.cumsum(lengths[at])])[ends]).tolist())
        size = np.dtype(self.kind).itemsize
        return [next(words) if p else len(self._one(t)) // size for t, p in zip(texts, plain)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, path: str, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """First pass: (key, n_tokens, part, before, ids), written once.

    ``part`` is the task, ``before`` counts the task's tokens before the row, ``ids`` are little-endian. Each text
    is followed by the id ``end``; a null text is the empty text and has that id alone.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, total = encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], own.kind).tobytes()
        for batch in byte_slices(batches, "text", SLICE):
            ids = [x + tail for x in own.encode(strings(batch, "text"))]
            counts = np.array([len(x) // len(tail) for x in ids], np.int64)
            before = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts), pa.array(np.full(len(ids), part, np.int32)), pa.array(before), pa.array(ids, pa.binary())],
                names=["key", "n_tokens", "part", "before", "ids"],
            )

    return written(source.mapInArrow(run, f"key {kind}, n_tokens long, part int, before long, ids binary"))


def cut(rows: DataFrame, size: int, wide: bool = False) -> DataFrame:
    """Second pass: windows and boundary records (sequence_id, first, n_tokens, ids, pieces) of ``tokenised`` rows.

    ``pieces`` holds, for each document in the window, key, start (its ids before the piece), length, doc_tokens,
    ids_crc32 (of the ids as unsigned 32-bit integers) and offset (in the sequence). A record with
    ``n_tokens = size`` is a whole sequence. ``wide`` tells that ids have four bytes.
    """
    kind, source = rows.schema["key"].dataType.simpleString(), "<u4" if wide else "<u2"
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a task of the first pass; written, so that Spark knows its size when it picks the join.
    offsets = written(totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset")))
    placed = rows.join(offsets, "part").select("key", "n_tokens", (F.col("offset") + F.col("before")).alias("place"), "ids")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, bytes]] = []
        pieces: list[list[tuple]] = []
        held, own, first, at = [], [], 0, -1  # the open window: its parts, its pieces, where it and the next row begin

        def close() -> None:
            nonlocal held, own
            if held:
                done.append((first // size, first % size, b"".join(held)))
                pieces.append(own)
                held, own = [], []

        def flush(key_type: pa.DataType) -> pa.RecordBatch:
            flat = list(zip(*chain.from_iterable(pieces)))
            types = (key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("key", "start", "length", "doc_tokens", "ids_crc32", "offset")
            struct = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, types)], names=names)
            stops = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            ids = [d[2] for d in done]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([len(x) // np.dtype(source).itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(stops), struct)],
                names=["sequence_id", "first", "n_tokens", "ids", "pieces"],
            )
            done.clear()
            pieces.clear()
            return batch

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            columns = (batch.column(c).to_pylist() for c in ("key", "n_tokens", "place"))
            ids_of = batch.column("ids")
            for i, (key, n, place) in enumerate(zip(*columns)):
                ids = np.frombuffer(ids_of[i].as_buffer(), source)
                if place != at:
                    close()
                start = 0
                while start < n:
                    here = place + start
                    if not held:
                        first = here
                    length = min(size - here % size, n - start)
                    part = ids[start:start + length]
                    held.append(part.tobytes())
                    own.append((key, start, length, n, zlib.crc32(part.astype("<u4").tobytes()), here % size))
                    start += length
                    if (here + length) % size == 0:
                        close()
                        if len(done) == 1024:
                            yield flush(key_type)
                at = place + n
        close()
        if done:
            yield flush(key_type)

    piece = f"key: {kind}, start: bigint, length: bigint, doc_tokens: bigint, ids_crc32: bigint, offset: bigint"
    return placed.mapInArrow(windows, f"sequence_id long, first long, n_tokens long, ids binary, pieces array<struct<{piece}>>")


def sequences(records: DataFrame, size: int) -> DataFrame:
    """Whole sequences (sequence_id, n_tokens, ids, pieces) from the records of ``cut``.

    Only boundary records are shuffled; a sequence has at most ``size`` of them. The last one is not padded.
    """
    records = written(records)
    whole = records.filter(F.col("n_tokens") == size).select("sequence_id", "n_tokens", "ids", "pieces")
    ends = records.filter(F.col("n_tokens") < size).groupBy("sequence_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "ids", "pieces"))).alias("r"))
    merged = ends.select(
        "sequence_id", "n_tokens", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.flatten(F.transform("r", lambda x: x["pieces"])).alias("pieces"))
    return whole.unionByName(merged)


def packed(docs: DataFrame, path: str, end: int, size: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Windows and boundary records over all documents.

    Null texts are empty; nulls and repeated values of ``key`` keep their rows; the longest texts are cut over as
    many windows as they need; an empty table has no record. Other columns are not read.
    """
    wide = encoder(path).kind != "<u2"
    return cut(tokenised(docs, path, end, text, key), size, wide)


def piece_rows(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each piece of a document, from records or sequences."""
    one = records.select("sequence_id", F.explode("pieces").alias("p"))
    return one.select(F.col("p.key").alias(key), "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")

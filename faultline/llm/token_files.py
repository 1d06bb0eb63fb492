"""Token-id files: static range asymmetric numeral coding in independent interleaved blocks.

One table of frequencies, counted over all ids, serves every block. A block holds whole documents in order:
their ids, lengths and place in the part, and the coded ids. Its ids are dealt over lanes, a step codes one id
of each lane, and the lanes share one stream of 32-bit words. Every ``SEGMENT`` steps there is a checkpoint,
the lanes' states and the place in the stream, so segments decode apart from each other, each with a checksum.

Blocks travel as rows (part, block, first, tokens, data); ``data`` is the block's bytes and needs nothing else
but the table. ``first`` is the block's place among the ids of its part.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from faultline.llm.common import byte_slices, gathered, slices, strings, written

MAGIC = b"RANS"
SCALE = 20  # frequencies add up to 2 to this power
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
LANES, SEGMENT = 1024, 256
BLOCK_TOKENS = 1 << 20
WIDEST_ALPHABET = 1 << 19  # so that a table has a proven size
HEAD = struct.Struct("<4sIQIIII")
TABLE_ENTRIES, LONGEST_KEPT = 500_000, 48
SLICE = 1 << 23  # texts are encoded in slices of about so many bytes
#: One run of Latin letters between ASCII signs. The signs stand in pre-tokens of their own (the apostrophe may
#: not, and is left out, like the sign that opens a special token), and letters of one run stand together.
SIGNS, LETTERS = r"[!-&(-/:;=-@\[-`{-~]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
PLAIN = f"^(?P<a>{SIGNS}*)(?P<b>{LETTERS}+)(?P<c>{SIGNS}*)$"

LOWER = re.compile("[a-zß-öø-ÿ]+")

_TOKENIZERS: dict[str, Words] = {}


class Words:
    """A tokenizer that drops white space and lower-cases, with a bounded table of distinct parts of words.

    Arrow kernels cut texts at blanks and number the distinct words. A word that is a run of letters between signs is
    taken apart; other words are one part. Each distinct part is looked up once per slice and ids are gathered by
    position. New runs of letters are encoded together in one text and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self._library([" \n "])[0] or self._library(["ÀB", "àb"])[0] != self._library(["àb"])[0]:
            raise ValueError("this tokenizer keeps white space or case; its texts cannot be cut into words")
        # Runs of lower-case letters need neither normalizer nor pattern: white space alone parts them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if any(not t.content.startswith("<") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token may be hidden between letters and signs")
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = kind_of(len(self.ends))
        self.kept: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self._library(texts)]

    def _letters(self, runs: list[str]) -> list[bytes]:
        """Ids of runs of lower-case letters, each one pre-token."""
        if not runs:
            return []
        ids = np.array(self.bare.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(runs):
            return self._packed(runs)
        data, size = ids.tobytes(), ids.itemsize
        stops = (stops * size).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, by the table."""
        if len(self.kept) > TABLE_ENTRIES:
            self.kept = {}
        missing = [p for p in parts if p not in self.kept]
        # Only runs of letters are wholly letters: other parts hold a sign, a digit or a letter of another script.
        runs = [p for p in missing if len(p) <= LONGEST_KEPT and LOWER.fullmatch(p)]
        rest = list(set(missing).difference(runs))
        self.kept.update(zip(runs, self._letters(runs)))
        self.kept.update(zip(rest, self._packed(rest)))
        found = list(map(self.kept.__getitem__, parts))
        for part in rest:
            if len(part) > LONGEST_KEPT:
                del self.kept[part]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids. Blank and line feed separate pre-tokens, so words are encoded on their own."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary
        match = pc.extract_regex(distinct, PLAIN)
        plain = pc.is_valid(match)
        a, b, c = (pc.fill_null(pc.struct_field(match, i), "") for i in range(3))
        coded = pa.concat_arrays([a, pc.if_else(plain, pc.utf8_lower(b), distinct), c]).dictionary_encode()
        ids_of = self._parts(coded.dictionary.to_pylist())
        size = np.dtype(self.kind).itemsize
        flat, lengths = np.frombuffer(b"".join(ids_of), self.kind), np.array([len(x) // size for x in ids_of], np.int64)
        at = coded.indices.to_numpy().reshape(3, -1).T.ravel()
        flat, lengths = gathered(flat, lengths, at), lengths[at].reshape(-1, 3).sum(axis=1)
        at = words.indices.to_numpy()
        data = gathered(flat, lengths, at).tobytes()
        stops = np.concatenate([[0], np.cumsum(lengths[at])])[cut.offsets.to_numpy()] * size
        return [data[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist())]


def kind_of(alphabet: int) -> str:
    """How ids travel before they are coded."""
    return "<u2" if alphabet <= 1 << 16 else "<u4"


def _words(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, path: str, end: int | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids): little-endian ids of each whole text, then the end id. Null is the empty text."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        tail = b"" if end is None else np.array([end], words.kind).tobytes()
        for batch in byte_slices(batches, "text", SLICE):
            ids = [row + tail for row in words.encode(strings(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return source.mapInArrow(run, "doc_id long, ids binary")


class Table:
    """Frequencies scaled to 2^SCALE, at least one for each id that occurs."""

    def __init__(self, counts: np.ndarray):
        if len(counts) > WIDEST_ALPHABET:
            raise ValueError("alphabet too wide")
        total = 1 << SCALE
        present = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(present):
            freq[present] = np.maximum(1, counts[present] * (total - len(present)) // counts.sum())
            freq[present[np.argmax(counts[present])]] += total - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int, segment: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (place in the stream and states) of each segment, and the stream. Coding runs backwards."""
        steps = -(-len(ids) // lanes)
        state, chunks, count, marks = np.full(lanes, LOW), [], 0, []
        for step in range(steps - 1, -1, -1):
            now = ids[step * lanes:(step + 1) * lanes]
            x, freq = state[:len(now)], self.freq[now]
            over = np.flatnonzero(x >= freq << np.uint64(63 - SCALE))
            if len(over):
                chunks.append((x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                x[over] >>= np.uint64(32)
                count += len(over)
            q = x // freq
            state[:len(now)] = (q << np.uint64(SCALE)) + (x - q * freq) + self.start[now]
            if step % segment == 0:
                marks.append((count, state.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
        return [(len(stream) - n, s) for n, s in reversed(marks)], stream

    def decode(self, state: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids from the states and the stream behind a checkpoint."""
        lanes, out, at = len(state), np.empty(n, np.uint32), 0
        mask, shift, wide = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for begin in range(0, n, lanes):
            x = state[:min(lanes, n - begin)]
            slot = x & mask
            ids = self.symbol[slot]
            x = self.freq[ids] * (x >> shift) + slot - self.start[ids]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << wide | words[at:at + len(low)]
            at += len(low)
            state[:len(x)] = x
            out[begin:begin + len(x)] = ids
        return out


def pack(table: Table, doc_ids: list[int | None], rows: list[bytes], kind: str) -> bytes:
    """One block: head, documents, checkpoints with checksums, stream, checksum of all that."""
    ids = np.frombuffer(b"".join(rows), kind).astype("<u4")
    data, width = ids.tobytes(), np.dtype(kind).itemsize
    lanes = LANES if len(ids) >= 64 * LANES else 32
    marks, stream = table.encode(ids, lanes, SEGMENT)
    span = lanes * SEGMENT
    sums = np.array([zlib.crc32(data[4 * span * i:4 * span * (i + 1)]) for i in range(len(marks))], "<u4")
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    docs += np.array([len(r) // width for r in rows], "<u4").tobytes()
    packed = zlib.compress(docs, 1)
    body = HEAD.pack(MAGIC, len(rows), len(ids), lanes, len(marks), len(packed), len(stream)) + packed + sums.tobytes()
    body += np.array([at for at, _ in marks], "<u8").tobytes() + b"".join(s.astype("<u8").tobytes() for _, s in marks)
    body += stream.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Packed:
    """A block's parts; each segment decodes by itself."""

    def __init__(self, data: bytes):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum")
        magic, docs, self.tokens, self.lanes, self.segments, size, words = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = HEAD.size
        raw = zlib.decompress(data[at:at + size])
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(raw, "<i8", docs).tolist(), raw[8 * docs:9 * docs])]
        self.lengths = np.frombuffer(raw, "<u4", docs, 9 * docs)
        at += size
        self.sums = np.frombuffer(data, "<u4", self.segments, at)
        at += 4 * self.segments
        self.places = np.frombuffer(data, "<u8", self.segments, at)
        at += 8 * self.segments
        self.states = np.frombuffer(data, "<u8", self.segments * self.lanes, at).reshape(self.segments, self.lanes)
        self.stream = np.frombuffer(data, "<u4", words, at + 8 * self.segments * self.lanes)

    def segment(self, table: Table, number: int) -> bytes:
        span = self.lanes * SEGMENT
        ids = table.decode(self.states[number].copy(), self.stream[int(self.places[number]):], min(span, self.tokens - span * number))
        data = ids.astype("<u4").tobytes()
        if zlib.crc32(data) != self.sums[number]:
            raise ValueError("segment checksum")
        return data


def shared_table(tokens: DataFrame, kind: str) -> Table:
    """The table over all ids; what reaches the driver is one count for each id of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            data = b"".join(batch.column("ids").to_pylist())
            more = np.bincount(np.frombuffer(data, kind))
            if len(more) > WIDEST_ALPHABET:
                raise ValueError("alphabet too wide")
            if len(more) > len(counts):
                counts, more = more, counts
            counts[:len(more)] += more
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(counts)


def write_blocks(tokens: DataFrame, table: Broadcast, parts: int, kind: str) -> DataFrame:
    """(part, block, first, tokens, data): documents in ascending doc_id order, nulls first.

    Rows that share a doc_id are ordered by their ids, so repeated rows can be dealt over parts.
    """
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, docs, rows, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            data = pack(table.value, docs, rows, kind)
            values = ((part, pa.int32()), (block, pa.int32()), (first, pa.int64()), (size // width, pa.int64()), (data, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["part", "block", "first", "tokens", "data"])

        for batch in slices(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                rows.append(ids)
                size += len(ids)
                if size >= width * BLOCK_TOKENS:
                    yield closed()
                    block, first, docs, rows, size = block + 1, first + size // width, [], [], 0
        if docs:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    dealt = tokens.select("doc_id", "ids").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "part int, block int, first long, tokens long, data binary")


def read_blocks(blocks: DataFrame, table: Broadcast) -> DataFrame:
    """(doc_id, start, ids) of every document: ``start`` counts the ids of all documents before it."""
    ends = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row per part, as many as the writer was told
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            packed = Packed(batch.column("data")[0].as_py())
            data = b"".join(packed.segment(table.value, i) for i in range(packed.segments))
            ends = np.cumsum(packed.lengths, dtype=np.int64)
            begins = ends - packed.lengths
            rows = [data[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist())]
            at = batch.column("first")[0].as_py() + batch.column("base")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed.doc_ids, pa.int64()), pa.array(begins + at, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.join(F.broadcast(starts), "part").select("first", "base", "data").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str, end: int | None, parts: int) -> DataFrame:
    """Encode every whole text, write the blocks to the shared folder, and read them back.

    An empty table gives no block and no row; an empty text without end id gives a document of no ids.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    context, kind = docs.sparkSession.sparkContext, _words(path).kind
    tokens = written(tokenised(docs, path, end))
    table = context.broadcast(shared_table(tokens, kind))
    blocks = written(write_blocks(tokens, table, parts, kind), "none")
    return read_blocks(blocks, table)


def digests(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A position between a character that is not white space and one that is white space ends a pre-token of
the byte-level pattern whatever stands around it; so does one between an ASCII letter and an ASCII digit.
Encoding is the same on either side of such a stable position, wherever the text was cut before it.

* Texts up to ``core`` characters are counted in one task. They are cut into words (``packing.Encoder``), so each
  distinct part of a word goes to the library once per bounded table.
* Longer texts become chunk rows, ``core`` characters each with ``overlap`` more on both sides, dealt over
  the cluster and encoded with offsets. Neighbouring chunks are spliced at the first stable position of
  their common zone where both have a token boundary.
* Where a zone has none (a text without white space), the overlap widens: the chunks on both sides are
  joined up to the next splice and that part is encoded as one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm.common import RUNS, STABLE, WHITE, byte_slices, slices, strings, written
from faultline.llm.packing import Encoder, encoder

WHITE_THEN_SPACE = re.compile(f"[{WHITE}] ")
TABLE_ENTRIES = 200_000
LONGEST_KEPT = 48
SLICE = 1 << 22  # texts are counted in slices of about so many bytes

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts of tokens, with a bounded table of distinct pieces.

    Where the tokenizer parts words at blanks, Arrow kernels number the distinct words and counts are summed by
    position. Other tokenizers look each word up in the table.
    """

    def __init__(self, path: str):
        self.words: Encoder | None
        try:
            self.words = encoder(path)
        except ValueError:
            self.words = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[str, int] = {}

    def _library(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.words:
            return self.words.counts(texts)
        heads, tails = [], []
        for text in texts:
            if WHITE_THEN_SPACE.search(text):
                # Words after their blank, as in the other branch; the rest as it stands.
                runs = RUNS.findall(text)
                tails.append([r[1:] for r in runs if r[0] == " "])
                heads.append([r for r in runs if r[0] != " "])
            else:
                words = text.split(" ")
                heads.append(words[:1])
                tails.append(words[1:])
        if len(self.kept) > TABLE_ENTRIES:
            self.kept = {}
        missing = list(set(chain.from_iterable(tails)).difference(self.kept))
        self.kept.update(zip(missing, self._library([" " + w for w in missing])))
        get = self.kept.__getitem__
        first = self._library(list(chain.from_iterable(heads)))
        counts, at = [], 0
        for head, tail in zip(heads, tails):
            counts.append(sum(first[at:at + len(head)]) + sum(map(get, tail)))
            at += len(head)
        for w in missing:
            if len(w) > LONGEST_KEPT:
                del self.kept[w]
        return counts

    def boundaries(self, text: str) -> list[int]:
        """Where each token of the text begins."""
        encoding = self.tokenizer.encode(text, add_special_tokens=False)
        return [start for start, _ in encoding.offsets]


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", core: int = 32_768,
                 overlap: int = 512) -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of each row's whole text.

    A null text is the empty text, which has no tokens. Nulls and repeated values of ``key`` keep their rows:
    a long text is put together by a number given to its row, not by ``key``. Other columns are not read.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    arrow_of = {"n_bytes": pa.int64(), "n_tokens": pa.int64(), "row": pa.int64(), "chunk": pa.int32(),
                "last": pa.bool_(), "low": pa.int64(), "piece": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = counter(path), TaskContext.get().partitionId() << 33
        for batch in byte_slices(batches, "text", SLICE):
            texts, keys = strings(batch, "text"), batch.column("key")
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            short = [i for i, t in enumerate(texts) if len(t) <= core]
            counts = dict(zip(short, own.count([texts[i] for i in short])))
            rows, at = [], []
            for i, t in enumerate(texts):
                if i in counts:
                    at.append(i)
                    rows.append((sizes[i], counts[i], None, None, None, None, None))
                    continue
                row += 1
                chunks = -(-len(t) // core)
                for c in range(chunks):
                    low = max(0, c * core - overlap)
                    at.append(i)
                    rows.append((sizes[i], None, row, c, c == chunks - 1, low, t[low:(c + 1) * core + overlap]))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(zip(*rows), arrow_of.values()))],
                names=["key", *arrow_of],
            )

    first = written(source.mapInArrow(
        cut, f"key {kind}, n_bytes long, n_tokens long, row long, chunk int, last boolean, low long, piece string"))
    short = first.filter("row is null").select(F.col("key").alias(key), "n_bytes", "n_tokens")
    chunks = first.filter("row is not null")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk and border: the stable token boundaries of the zone and the tokens before them."""
        own = counter(path)
        for batch in slices(batches, 16):
            out = []
            for r in batch.to_pylist():
                starts, n = own.boundaries(r["piece"]), len(r["piece"])
                exact = set(starts)
                for side, border in ((0, r["chunk"] + 1), (1, r["chunk"])):
                    middle = border * core - r["low"]
                    if border == 0 or (side == 0 and r["last"]):
                        continue
                    zone = [m.start() for m in STABLE.finditer(r["piece"], max(0, middle - overlap), min(n, middle + overlap))]
                    zone = [p for p in zone if p in exact and middle - overlap < p < middle + overlap]
                    out.append((r["row"], border, side, [p + r["low"] for p in zone], [bisect_left(starts, p) for p in zone], 0))
                if r["last"]:
                    out.append((r["row"], -1, 2, [], [], len(starts)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            names = ["row", "border", "side", "at", "before", "total"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    ends = chunks.select("row", "chunk", "last", "low", "piece").repartition("row", "chunk").mapInArrow(
        borders, "row long, border int, side int, at array<long>, before array<long>, total long")
    ends = written(ends)
    left = ends.filter("side = 0").select("row", "border", F.col("at").alias("l_at"), F.col("before").alias("l_before"))
    right = ends.filter("side = 1").select("row", "border", F.col("at").alias("r_at"), F.col("before").alias("r_before"))
    spliced = left.join(right, ["row", "border"]).withColumn("p", F.array_min(F.array_intersect("l_at", "r_at"))).select(
        "row", "border", "p",
        (F.get("l_before", (F.array_position("l_at", F.col("p")) - 1).cast("int"))
         - F.get("r_before", (F.array_position("r_at", F.col("p")) - 1).cast("int"))).alias("delta"),
    )
    spliced = written(spliced)
    totals = spliced.select("row", F.col("delta").alias("n"), F.col("p").isNull().cast("int").alias("open")).unionByName(
        ends.filter("side = 2").select("row", F.col("total").alias("n"), F.lit(0).alias("open")))
    totals = totals.groupBy("row").agg(F.sum("n").alias("n"), F.max("open").alias("open"))

    # Widened parts: from one splice to the next, over every border that has none.
    failed = totals.filter("open = 1").select("row")
    order = Window.partitionBy("row").orderBy("chunk")
    parts = (
        chunks.join(failed, "row", "left_semi").select("row", "chunk", "low", "piece")
        .join(spliced.select("row", F.col("border").alias("chunk"), "p"), ["row", "chunk"], "left")
        .withColumn("part", F.sum(F.col("p").isNotNull().cast("int")).over(order))
        .withColumn("cut", F.expr(f"substring(piece, cast(chunk * {core}L - low + 1 as int), {core})"))
        .groupBy("row", "part")
        .agg(F.min("chunk").alias("chunk"), F.max("p").alias("p"),
             F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "cut"))), lambda x: x["cut"]), "").alias("cut"))
    )
    ordered = Window.partitionBy("row").orderBy("part")
    # A part starts at its splice, which may lie before or behind its first chunk's core.
    parts = parts.withColumn("next_p", F.lead("p").over(ordered)).withColumn("before", F.lag("cut").over(ordered)).withColumn(
        "after", F.lead("cut").over(ordered)).withColumn("start", F.col("chunk") * F.lit(core)).withColumn(
        "next_start", F.lead("start").over(ordered))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, 16):
            rows = batch.to_pylist()
            whole = []
            for r in rows:
                t, low, high = r["cut"], r["p"], r["next_p"]
                if low is not None:
                    t = t[low - r["start"]:] if low >= r["start"] else r["before"][low - r["start"]:] + t
                if high is not None:
                    t = t + r["after"][:high - r["next_start"]] if high >= r["next_start"] else t[:high - r["next_start"]]
                whole.append(t)
            counts = [len(own.boundaries(t)) for t in whole]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64())], names=["row", "n"])

    again = parts.mapInArrow(recount, "row long, n long").groupBy("row").agg(F.sum("n").alias("n_tokens"))
    long = totals.filter("open = 0").select("row", F.col("n").alias("n_tokens")).unionByName(again)
    named = chunks.filter("chunk = 0").select("row", F.col("key").alias(key), "n_bytes")
    return short.unionByName(named.join(long, "row").select(key, "n_bytes", "n_tokens"))

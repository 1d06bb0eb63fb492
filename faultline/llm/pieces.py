"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of the model crosses from a letter to a whitespace marker, so a text is cut in front of every
run of markers, each distinct marked word is segmented once, and the ids are joined back by position.
The table lives in the task, is bounded in entries, and is refilled when it is full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import slices, strings

MARK = "▁"
RUNS = re.compile(f"[ {MARK}]+[^ {MARK}]*")
TABLE_ENTRIES = 150_000
LONGEST_KEPT = 48

_TABLES: dict[str, WordTable] = {}


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker (the model adds that one itself)."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in RUNS.findall(" " + text)]
    return text.split(" ")


class WordTable:
    """Distinct marked words and their ids."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        self.ids: dict[str, list[int]] = {}

    def _fill(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of the words; long ones are encoded but not kept."""
        if len(self.ids) > TABLE_ENTRIES:
            self.ids = {}
        # A lone marker is a word whose text is empty; the model would encode that to nothing.
        self.ids.setdefault("", [self.model.piece_to_id(MARK)])
        missing = list(words.difference(self.ids))
        found = dict(zip(missing, self.model.encode(missing, num_threads=1)))
        long = {w: found.pop(w) for w in missing if len(w) > LONGEST_KEPT}
        self.ids.update(found)
        return long

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [marked_words(t) for t in texts]
        long = self._fill(set(chain.from_iterable(cut)))
        if not long:
            get = self.ids.__getitem__
            return [list(chain.from_iterable(map(get, words))) for words in cut]
        return [list(chain.from_iterable(long[w] if w in long else self.ids[w] for w in words)) for words in cut]

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.model.decode(rows, num_threads=1) if rows else []


def word_table(path: str) -> WordTable:
    """The worker's table for a model file, kept between tasks."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` (whole text and one end id) and ``decoded`` (the model's text of the ids).

    Nulls in ``text`` count as the empty text, whose ids are the end id alone; nulls elsewhere pass through,
    repeated rows each get their row, an empty table gives none, and other columns are not read.
    """
    source = docs.select(*keep, F.col(text).alias("_text"))
    fields = [source.schema[c] for c in keep]
    schema = T.StructType([
        *fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        end = [table.model.eos_id()]
        for batch in slices(batches):
            ids = [row + end for row in table.encode(strings(batch, "_text"))]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(table.decode(ids), pa.string())],
                names=[*keep, "ids", "decoded"],
            )

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Counts and digests of ``encode_decode``'s rows."""
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

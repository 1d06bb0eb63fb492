"""Importance resampling towards a target: draw the documents whose word runs look like the target's.

Features are runs of one to ``LONGEST`` words, hashed into buckets. One pass counts the buckets of all documents
and of the target texts, pre-aggregated in each task. A bucket's gain is the logarithm of the ratio of its smoothed
shares; a second pass adds up the gains of each document's features. Gumbel noise from the document's id makes the
highest sums a draw without replacement in proportion to the importance weights.

In tasks, Arrow kernels lower the text and cut it into words; the words become dictionary indices, and indices
shifted by one and two places make pairs and triples. Distinct pairs are numbered and hashed once per slice: the
checksum of a pair goes on from that of its first word. Gains are taken by number and added up per document.

The draw is ranked by a range shuffle of (score, id) rows; ranks come from prefix sums over the ranges' sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import byte_slices, written

#: What stands between words: every ASCII character but digits and lower-case letters (after lower-casing).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 3
SLICE = 1 << 22


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Dictionary indices of all words in order, the distinct words, and where each text's words begin (and end)."""
    cut = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), GAP)
    flat, parents = pc.list_flatten(cut), pc.list_parent_indices(cut)
    real = pc.greater(pc.binary_length(flat), 0)  # a gap at either end of a text leaves an empty word
    words = pc.dictionary_encode(flat.filter(real))
    sizes = np.bincount(parents.filter(real).to_numpy(), minlength=len(texts))
    return words.indices.to_numpy().astype(np.int64), words.dictionary, np.concatenate([[0], np.cumsum(sizes)])


def _runs(index: np.ndarray, distinct: pa.Array, starts: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run: the bucket of each distinct run, and its number at each position of all words.

    The number is -1 where a run would cross the end of its text.
    """
    words = [w.encode() for w in distinct.to_pylist()]
    checks = np.array([zlib.crc32(w) for w in words], np.uint32)
    yield checks % buckets, index
    later, number, width = [b" " + w for w in words], index, len(words) or 1
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for n in range(2, LONGEST + 1):
        pairs = np.full(len(index), -1)
        fits = row[n - 1:] == row[:len(row) - n + 1]
        at = np.flatnonzero(fits)
        coded = pc.dictionary_encode(pa.array(number[at] * width + index[at + n - 1]))
        pairs[at] = coded.indices.to_numpy()
        found = coded.dictionary.to_numpy()
        checks = np.array([zlib.crc32(later[w], c) for w, c in zip((found % width).tolist(), checks[found // width].tolist())], np.uint32)
        yield checks % buckets, pairs
        number = pairs


def bucket_counts(texts: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n) over all features of all rows; a bucket without features has no row. Null texts have none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in byte_slices(batches, "text", SLICE):
            for own, number in _runs(*_words(batch.column("text")), buckets):
                times = np.bincount(number[number >= 0], minlength=len(own))
                total += np.bincount(own, weights=times, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the logarithm of target share over document share, rounded down."""
    spark = documents.sparkSession
    sides = documents.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))).unionByName(
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    both = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # One row a bucket, so this window holds a fixed number of rows.
    s, t = (F.col(c).cast("double") for c in "st")
    all_s, all_t = (F.sum(c).over(Window.partitionBy()).cast("double") for c in "st")
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of each row; a null or wordless text has zeros."""
    source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    kind = source.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "_text", SLICE):
            index, distinct, starts = _words(batch.column("_text"))
            total = np.zeros(len(index), np.int64)
            for own, number in _runs(index, distinct, starts, len(gain)):
                total += np.append(gain[own], 0)[number]  # number -1 takes the zero
            sums, sizes = np.concatenate([[0], np.cumsum(total)]), np.diff(starts)
            features = sum(np.maximum(sizes - n, 0) for n in range(LONGEST))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes), pa.array(features), pa.array(sums[starts[1:]] - sums[starts[:-1]])],
                names=[key, "n_words", "n_features", "weight"])

    return source.mapInArrow(weigh, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform)))


def ranked(scored: DataFrame, drawn: Column, percent: int, parts: int, key: str = "doc_id") -> DataFrame:
    """Rows with ``rank`` 1, 2, 3... for the ``percent`` of the rows that ``drawn`` marks with the highest ``score``.

    Equal scores stand in the order of ``key`` (null first); rows that are equal in both take either order. All
    other rows have a null rank. Ranges break inside ties, so no score or key can fill one range.
    """
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()).withColumn("_drawn", drawn))
    order = [F.col("score").desc(), F.col(key).asc(), F.col("_row").asc()]
    dealt = scored.filter("_drawn").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Written in order: high bits tell the range, low bits the place in it.
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_drawn", "_row"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: a fixed number of rows.
    sizes = written(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                                 F.sum("_n").over(Window.partitionBy()).alias("_all")))
    rank = F.col("_before") + place
    placed = dealt.join(sizes, "_range").withColumn("rank", F.when(rank <= F.floor(F.col("_all") * percent / F.lit(100)), rank))
    rest = scored.filter("not _drawn").drop("_drawn", "_row").withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("_range", "_before", "_all", "_at").unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, parts: int, buckets: int = 10_000, percent: int = 5, seed: int = 42,
              least_words: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; ``rank`` numbers the drawn ones.

    Null and wordless texts have no features, weight 0 and are never drawn, like all under ``least_words`` words. A
    null key counts as empty in the noise. Repeated rows are rows of their own; without documents there is no row,
    without target texts every gain is that of an empty target. Other columns are not read.
    """
    table = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text), buckets)
    gain = np.zeros(buckets, np.int64)
    for row in table.collect():  # one row a bucket
        gain[row["bucket"]] = row["gain"]
    scored = weights(docs, gain, text, key).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return ranked(scored, F.col("n_words") >= least_words, percent, parts, key)

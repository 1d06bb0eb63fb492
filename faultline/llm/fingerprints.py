"""Document fingerprints: bottom-k sketches of shingle hashes, on built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's shingles (five words; a
text of fewer words is one shingle). Sketches of parts merge into the sketch of the whole, and estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.arrays import let

K = 128
SHINGLE = 5
BITS = 48


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text; the empty and the null text have the empty sketch."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")

    def short(value: Column) -> Column:
        return F.shiftrightunsigned(value, 64 - BITS)

    def shingles(hashes: Column) -> Column:
        whole = F.when(F.size(hashes) > 0, F.array(short(F.xxhash64(hashes)))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(hashes) - size, F.lit(0))),
            lambda i: short(F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])),
        )
        return F.when(F.size(hashes) < size, whole).otherwise(each)

    found = let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both shingle sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection by union, exact while the union has fewer than ``k`` shingles; 1 for two empty sets."""
    shared = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 for an empty ``a``."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared))


def merged(sketches: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group. Only the ``k`` smallest hashes of a group leave each task."""
    hashes = sketches.select(by, F.explode(column).alias("hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("hash"))
    lowest = hashes.withColumn("rank", rank).filter(F.col("rank") <= k)
    return lowest.groupBy(by).agg(F.sort_array(F.collect_list("hash")).alias(column))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")


def edited_fingerprints(docs: DataFrame, buckets: int) -> DataFrame:
    """Sketches of every text, of its edited text, and of the next document's text.

    The edited text has the text's last half (rounded down) replaced by as many first characters of the next
    document, in ascending doc_id order (null first, equal ids by text), after the last the first; a lone
    document follows itself. Null is the empty text. Rows are put in order in ``buckets`` ranges of doc_id, and
    each range ends with a copy of the first row of the next, so no range looks beyond itself.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("place"))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.select("place").agg(F.percentile_approx("place", shares, 100 * buckets).alias("b")).first()["b"] or [])) if shares else []
    at = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("place"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", at)
    firsts = rows.groupBy("bucket").agg(F.min("place").alias("place")).orderBy("bucket").collect()  # one row per bucket
    spark = docs.sparkSession
    targets = spark.createDataFrame(
        [(r["place"], r["bucket"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)], "place long, bucket int, target int")
    ends = (
        rows.join(F.broadcast(targets), ["place", "bucket"]).groupBy("bucket", "target").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("place"), F.col("target").alias("bucket"), F.lit(1).alias("end"))
    )
    order = Window.partitionBy("bucket").orderBy("end", "place", "text")
    rows = rows.withColumn("end", F.lit(0)).unionByName(ends).withColumn("next_text", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "text", "place", "bucket", "end", F.coalesce(edited, F.lit("")).alias("edited"))
    rows = rows.select(
        "doc_id", "text", "place", "bucket", "end", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("sketch"),
        sketch(F.col("edited")).alias("edited_sketch"))
    return rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter("end = 0").select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))

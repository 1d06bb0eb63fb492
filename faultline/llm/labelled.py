"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

import ctypes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import remainder


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 3,
                    held_out: int = 1) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows outside the held-out fold, chosen by a hash of the id.

    The bound is the only thing that reaches the driver. Rows without an id or label teach nothing; a null
    text is the empty text; a repeated id takes its largest label and each of its texts.
    """
    marked = labels.select("doc_id", F.col(label).alias("_label")).filter(
        F.col("_label").isNotNull() & (remainder("doc_id", folds) != held_out)
    ).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    chosen = docs.select("doc_id").join(marked, "doc_id").select("doc_id", "_label").distinct().orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most).collect()
    return [(r["text"] or "", int(r["_label"])) for r in found]


def forgotten(*tables: dict) -> None:
    """Empty the tables of words that a fit has filled, and give the memory of its rows back to the system.

    The driver lives on after a fit, and only tasks read such tables later, each from its own process. The texts
    lie between objects that stay, so the C library would keep their pages; one without ``malloc_trim`` does.
    """
    for table in tables:
        table.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

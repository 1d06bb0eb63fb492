"""Records of files that are one JSON array each, however large.

A file is read in fragments that end at a closing brace, which Spark's text source splits by byte ranges on any file
system. Whether a fragment starts inside a string, and how deep it starts, follows from all fragments before it, but
only through two numbers each fragment adds: the parity of its quotes, and the brackets it opens outside strings
(which depends on that parity alone, so both cases are counted). Both sums run over the file's fragments by chunks.

A record ends where a closing brace outside strings leads back to depth one. What stands between two such ends is one
record with the comma (and any elements that are no objects) before it, and is parsed as a small array of its own. A
file whose pieces do not all parse is no array, and gives no row at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import jsonpath as j
from faultline.functions.barrier import computed_once
from faultline.functions.sequence import with_running_sum
from faultline.session import cut_lineage

CHUNK_BITS = 12
_WHERE = ["file", "block", "row"]


def _fragments(spark: SparkSession, path) -> DataFrame:
    """``file, block, row, value``: fragments between closing braces, in the order of the three."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value", F.col("_metadata.file_size").alias("file_size"))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _opened(outside: Column, ends_outside: Column) -> Column:
    """Brackets opened less brackets closed, with the brace that ends the fragment."""
    return (_count(outside, "[") + _count(outside, "{") - _count(outside, "]") - ends_outside.cast("int")).cast("long")


def _facts(fragments: DataFrame) -> DataFrame:
    """Per fragment: ``quotes`` (parity), and ``opened`` if it starts outside or inside a string."""
    # An escape is a backslash and one character, and no escape is a brace.
    bare = computed_once(fragments, _bare=F.regexp_replace("value", r"(?s)\\.", ""))
    strings, head = r'(?s)"[^"]*("|\z)', r'(?s)^[^"]*("|\z)'
    odd = _count(F.col("_bare"), '"') % 2 == 1
    outside = F.regexp_replace("_bare", strings, "")
    inside = F.regexp_replace(F.regexp_replace("_bare", head, ""), strings, "")
    return bare.select(
        *_WHERE, "file_size", (F.octet_length("value") + 1).alias("bytes"), odd.cast("long").alias("quotes"), _opened(outside, ~odd).alias("opened_outside"),
        _opened(inside, odd).alias("opened_inside"))


def _pieces(spark: SparkSession, path) -> DataFrame:
    """``file, piece, text, closed``: the stretches between record ends; the last one of a file is not ``closed``."""
    fragments = _fragments(spark, path)
    chunk = F.struct("block", F.shiftright("row", CHUNK_BITS).alias("row"))
    facts = cut_lineage(_facts(fragments).withColumn("chunk", chunk))
    order = ["block", "row"]
    placed = with_running_sum(facts, ["file"], "chunk", order, F.col("quotes"), "_quotes")
    starts_inside = F.col("_quotes") % 2 == 1
    opened = F.when(starts_inside, F.col("opened_inside")).otherwise(F.col("opened_outside"))
    placed = placed.withColumn("opened", opened).withColumn("outside", (F.col("_quotes") + F.col("quotes")) % 2 == 0)
    placed = with_running_sum(placed, ["file"], "chunk", order, F.col("opened"), "_depth")
    ends = F.col("outside") & (F.col("_depth") + F.col("opened") == 1)
    placed = with_running_sum(placed.withColumn("ends", ends), ["file"], "chunk", order, F.col("ends").cast("long"), "piece")
    # Behind the last fragment of a file there is a brace only if the file's size says so; it then is no array.
    last = facts.groupBy("file").agg(
        F.max(F.struct(*order)).alias("last"), (F.sum("bytes") == F.max("file_size")).alias("brace_at_end"))
    held = fragments.drop("file_size").join(placed.select(*_WHERE, "piece", "ends"), _WHERE)
    text = F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda x: x["value"])
    pieces = held.groupBy("file", "piece").agg(
        F.array_join(text, "}").alias("text"), F.max("ends").alias("closed"), F.max(F.struct(*order)).alias("_end"))
    pieces = pieces.join(last, "file").withColumn("_last", F.col("_end") == F.col("last"))
    return pieces.select(
        "file", "piece", (F.col("closed") & ~F.col("_last")).alias("closed"),
        F.when(F.col("_last") & F.col("brace_at_end"), F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"))


def read_array_records(spark: SparkSession, path) -> DataFrame:
    """``record VARIANT, file`` of every object in the arrays; other elements are left out, broken files give no row."""
    body = F.when(F.col("closed"), F.concat("text", F.lit("}]"))).otherwise(F.col("text"))
    # Every piece but a file's first goes on behind an element.
    whole = F.when(F.col("piece") == 0, F.when(F.ltrim("text", F.lit(" \t\r\n")).startswith("["), body)).otherwise(F.concat(F.lit("[0"), body))
    parsed = cut_lineage(_pieces(spark, path).select("file", "piece", whole.alias("text")))
    parsed = computed_once(parsed, value=j.parse_strict(F.col("text"))).drop("text")
    good = parsed.withColumn("ok", F.coalesce(j.is_array(F.col("value")), F.lit(False)))
    broken = good.filter("not ok").select("file").distinct()
    items = j.array_at(F.col("value"), "$")
    own = F.when(F.col("piece") == 0, items).otherwise(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))))
    records = good.join(broken, "file", "left_anti").select(F.explode(own).alias("record"), "file")
    return records.filter(j.is_object(F.col("record")))

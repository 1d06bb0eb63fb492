import json
import re

from pyspark.sql import functions as F

from faultline.operators.signals import signals_from_steps
from faultline.sources import derived
from faultline.sources.seen import unseen
from faultline.streaming.arrivals import append_batches, run_stream
from faultline.streaming.sessions import session_signals
from faultline.streaming.windows import fingerprint_windows
from tests.runs import CASES


def test_arriving_runs_append_cards_and_history(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    cards, trend = str(tmp_path / "cards"), str(tmp_path / "trend")

    def deliver(name, cases):
        (inbox / name).write_text("\n".join(json.dumps(r) for r, _, _ in cases))
        append_batches(run_stream(spark, str(inbox)), cards, trend, str(tmp_path / "checkpoint")).awaitTermination()

    deliver("a.jsonl", CASES[:5])
    deliver("b.jsonl", CASES[5:])
    assert spark.read.parquet(cards).count() == len(CASES)
    rows = spark.read.parquet(trend).orderBy("ts").collect()
    assert [r["count"] for r in rows] == [5, len(CASES) - 5]
    assert json.loads(rows[0].distribution)["TOOL_USE"] == 3 and rows[0].rule_rate == 1.0


def test_known_runs_get_no_second_card(spark, tmp_path):
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    cards = str(tmp_path / "cards")

    def deliver(name, cases):
        (inbox / name).write_text("\n".join(json.dumps(r) for r in cases))
        append_batches(run_stream(spark, str(inbox)), cards, str(tmp_path / "trend"), str(tmp_path / "c"), store=store).awaitTermination()

    documents = [r for r, _, _ in CASES]
    deliver("a.jsonl", documents[:6] + [{**documents[0], "run_id": "gutted-again"}])
    deliver("b.jsonl", [{**r, "run_id": f"{r['run_id']}-2"} for r in documents[3:9]])
    found = {r.run_id for r in spark.read.parquet(f"{cards}/batch=1").select("run_id").collect()}
    assert found == {f"{r['run_id']}-2" for r in documents[6:9]}
    assert spark.read.parquet(f"{cards}/batch=0").count() == 6
    batch = spark.read.schema(run_stream(spark, str(inbox)).schema).json(str(inbox / "b.jsonl"))
    plan = unseen(batch, store, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan)
    assert unseen(batch, store, 1).count() == 3  # a repeated batch finds its own runs unseen


def test_windows_on_a_stream_equal_the_closed_batch_windows(spark, sample, tmp_path):
    path = str(tmp_path / "steps")
    steps = derived.steps(spark, sample).withColumn("ts", F.col("ts").cast("timestamp"))
    steps.coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).parquet(path)
    query = (
        fingerprint_windows(stream, watermark="1 day").writeStream.format("memory").queryName("windows").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    streamed = {tuple(r) for r in spark.table("windows").collect()}
    batch = {tuple(r) for r in fingerprint_windows(stored).collect()}
    closed = max(r[0] for r in streamed)
    assert streamed == {r for r in batch if r[0] <= closed} and len(streamed) > 20


def test_runs_that_arrive_in_pieces_equal_the_batch(spark, sample, tmp_path):
    """Steps of runs come shuffled over files, some after their session is closed; closed sessions equal the batch."""
    steps = derived.steps(spark, sample).filter("run_id IN (SELECT run_id FROM VALUES 'run-8', 'run-9', 'run-16', 'run-17', 'run-24') OR index < 9")
    names = sorted(r.run_id for r in steps.select("run_id").distinct().collect())
    # Each run's steps follow within a minute; runs begin an hour apart.
    place = F.array_position(F.array(*map(F.lit, names)), F.col("run_id"))
    timed = steps.withColumn("ts", F.timestamp_seconds(place * 3600 + F.col("index")))
    rows = sorted(timed.collect(), key=lambda r: hash((r.run_id, r["index"] * 7919 % 13)))
    files = [[r for r in rows if (names.index(r.run_id) * 2 + r["index"] % 2) // 6 == n] for n in range(len(names) // 3 + 1)]
    inbox = tmp_path / "in"
    late = [r for r in files[0] if r.run_id == names[0]][:3]
    kept = [r for r in rows if not (r in late)]
    files = [[r for r in f if r not in late] for f in files] + [late]
    for n, part in enumerate(f for f in files if f):
        spark.createDataFrame(part, timed.schema).coalesce(1).write.mode("append").parquet(f"{inbox}/{n:03d}")
    end = spark.createDataFrame([rows[0]], timed.schema).withColumn("run_id", F.lit("end")).withColumn("ts", F.timestamp_seconds(F.lit(10**7)))
    end.coalesce(1).write.parquet(f"{inbox}/999")
    runs = derived.runs(spark, sample).filter(F.col("run_id").isin(names)).cache()
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(inbox))
    query = (
        session_signals(stream, runs, "30 minutes", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.table("sessions")
    batch = signals_from_steps(spark.createDataFrame(kept, timed.schema), runs)
    assert sorted(map(str, found.select(batch.columns).collect())) == sorted(map(str, batch.filter("step_count > 0").collect()))
    assert found.count() == len(names) > 10

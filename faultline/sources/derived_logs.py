"""Raw agent logs derived from documents: one record per document, in every supported format.

The sentences of a document become the events, messages or transcript lines of a record; their kinds
follow from length and position. Each record is made and read inside its document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.barrier import computed_once

KINDS = 7
# A point or a line break ("\r\n" counting once): one character class, as it is tried at every character.
SENTENCE_END = "[.\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", _split("text").alias("s"))


def _split(text: str) -> Column:
    return F.split(text, SENTENCE_END)


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores when the files have fewer splits than that; larger inputs stay where they are."""
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def _kind(sentence: Column, i: Column) -> Column:
    return (F.length(sentence) + i) % KINDS


def _object(**members: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]))


def _by_kind(sentence: Column, i: Column, *values: Column) -> Column:
    kind = _kind(sentence, i)
    case = F.when(kind == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        case = case.when(kind == k, v)
    return case


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _record(docs: DataFrame, *members: Column) -> DataFrame:
    text = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    # The text is put together here, so that nothing can follow its value.
    return computed_once(docs, record=F.try_parse_json(text)).select("doc_id", "record")


def _member(name: str, json_text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), json_text)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _id() -> Column:
    return _quoted(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))


def _history_event(s: Column, i: Column) -> Column:
    agent, environment = F.lit("agent"), F.lit("environment")
    return _by_kind(
        s, i,
        _object(source=agent, action=F.lit("run"), command=s),
        _object(source=environment, observation=F.lit("run"), content=s, extras=F.struct((i % 3).alias("exit_code"))),
        _object(
            source=agent, action=F.lit("Edit"),
            args=F.struct(F.concat(F.lit("src/m"), (i % 5).cast("string"), F.lit(".py")).alias("path")),
        ),
        _object(source=agent, observation=F.lit("note"), content=s, exit_code=F.lit("1")),
        _object(type=F.lit("message"), message=s),
        _object(source=environment, observation=F.lit("error"), message=s),
        _object(source=agent, action=F.lit("finish"), thought=s, args=F.struct(F.lit(1).alias("n"), F.lit("").alias("s"))),
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-history records: ``doc_id, record``."""
    docs = _sentences(spark, sf_dir)
    resolved = F.when(F.col("doc_id") % 3 == 0, F.lit("null")).otherwise((F.col("doc_id") % 3 == 1).cast("string"))
    block = F.when(F.col("doc_id") % 2 == 0, '{"resolved":true,"git_patch":"diff --git"}').otherwise("{}")
    return _record(
        docs, _member("instance_id", _id()), _member("resolved", resolved), _member("test_result", block),
        _member("history", _list(F.transform("s", _history_event))),
    )


EVENT_SPAN = 1 << 20  # positions of one document in the history of its source


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event histories as ``run_id, pos, event VARIANT``, one row an event: a source's documents are one history."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    sentences = docs.select("doc_id", "source", F.posexplode(_split("text")).alias("i", "s"))
    text = _history_event(F.col("s"), F.col("i"))
    return sentences.select(
        F.concat(F.lit("openhands-"), "source").alias("run_id"), (F.col("doc_id") * EVENT_SPAN + F.col("i")).alias("pos"),
        F.parse_json(text).alias("event"))


def sdk_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace records with structured actions: ``doc_id, record, file_stem``."""

    def block(s: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), s.alias("text"))

    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("ignored").alias("text"))

    def event(s: Column, i: Column) -> Column:
        agent, environment = F.lit("agent"), F.lit("environment")

        def kind(name: str, **members: Column) -> Column:
            return F.struct(F.lit(name).alias("kind"), *[c.alias(n) for n, c in members.items()])

        return _by_kind(
            s, i,
            _object(source=agent, action=kind("RunAction", thought=F.array(block(s), tool))),
            _object(source=environment, observation=F.struct(F.array(block(s)).alias("content"))),
            _object(source=agent, action=kind("File_EditAction"), message=F.array(block(F.lit("a")), block(s))),
            _object(source=environment, observation=F.lit("run"), content=s),
            _object(source=agent, action=kind("Finish"), thought=s),
            _object(type=F.lit("think"), message=s),
            _object(source=agent, action=kind("CodeActionActAction"), code=F.concat(F.lit("x"), i.cast("string"))),
        )

    docs = _sentences(spark, sf_dir)
    named = F.when(F.col("doc_id") % 2 == 0, _member("instance_id", _id()))
    records = _record(docs, named, _member("resolved", F.lit("false")), _member("events", _list(F.transform("s", event))))
    return records.withColumn("file_stem", F.concat(F.lit("stem-"), F.col("doc_id").cast("string")))


ACTION_WORDS = ("bash", "edit", "view", "search_dir", "finish", "Submit", "dance")


def action_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action-list records: ``doc_id, record``."""

    def event(s: Column, i: Column) -> Column:
        word = F.array(*[F.lit(w) for w in ACTION_WORDS])[_kind(s, i)]
        seen = (
            F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, s).when(i % 5 == 2, F.concat(s, F.lit(" Error")))
            .when(i % 5 == 3, F.concat(F.lit("exit code: 0 "), s)).otherwise("  \t")
        )
        return _object(action=F.concat(word, F.lit("\n"), s), observation=seen)

    docs = _sentences(spark, sf_dir)
    state = F.when(F.col("doc_id") % 4 == 0, "exit_cost").otherwise("Submitted")
    info = _object(
        exit_status=state, resolved=F.col("doc_id") % 3 == 0,
        submission=F.when(F.col("doc_id") % 5 == 0, F.lit("  diff a\n ")),
        model_stats=F.struct(F.col("doc_id").alias("api_calls")),
    )
    return _record(
        docs, _member("instance_id", _id()), _member("info", info),
        _member("trajectory", _list(F.transform("s", event))),
    )


def _transcript_line(s: Column, i: Column) -> Column:
    command = F.concat(F.lit("> "), s)
    return _by_kind(
        s, i, command, F.lit("Applied edit to src/m.py"), F.concat(F.lit("Error: "), s), command,
        s, F.concat(F.lit("> git commit "), s), s,
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as ``run_id, chunk, pos, line``: a source's documents are one transcript."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    lines = docs.select("doc_id", "source", F.posexplode(_split("text")).alias("i", "s"))
    return lines.select(
        F.concat(F.lit("aider-"), "source").alias("run_id"), F.floor(F.col("doc_id") / 8).alias("chunk"),
        (F.col("doc_id") * EVENT_SPAN + F.col("i")).alias("pos"), _transcript_line(F.col("s"), F.col("i")).alias("line"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records that hold a chat transcript: ``doc_id, record``."""

    docs = _sentences(spark, sf_dir)
    chat = _object(chat_history=F.array_join(F.transform("s", _transcript_line), "\n"))
    return _record(
        docs, _member("instance_id", _id()), _inner(chat),
        _member("files_edited", F.lit('["a.py"]')),
    )


def _inner(object_text: Column) -> Column:
    """The members of a JSON object, without its braces."""
    return F.substring(object_text, F.lit(2), F.length(object_text) - 2)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records with a summary instead of a transcript: ``doc_id, record``."""
    docs = _sentences(spark, sf_dir)
    d = F.col("doc_id")
    files = F.filter(
        F.transform("s", lambda s, i: F.when(_kind(s, i) == 2, _quoted(F.concat(F.lit("f"), i.cast("string"), F.lit(".py"))))),
        lambda f: f.isNotNull(),
    )
    commits = F.when(
        d % 3 == 0,
        _member("commits", _list(F.array(
            F.lit('{"message":"first"}'),
            _object(message=F.concat(F.lit("fix "), d.cast("string")), diff=F.lit("diff --git")),
        ))),
    )
    error = F.when(d % 4 == 0, _member("error", _quoted(F.concat(F.lit("crash "), d.cast("string"))))).when(
        d % 4 == 1, _member("error", F.lit("null"))
    )
    status = F.when(d % 5 != 0, _member("exit_status", (d % 2).cast("string")))
    return _record(
        docs, _member("task_id", _id()), _member("files_edited", _list(files)), commits, error, status,
        _member("cost", F.lit("0.25")),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records with tool calls: ``doc_id, record``."""

    def call(i: Column, suffix: str, name: str, arguments: Column) -> Column:
        return F.struct(
            F.concat(F.lit("c"), i.cast("string"), F.lit(suffix)).alias("id"),
            F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"),
        )

    def message(s: Column, i: Column) -> Column:
        arguments = F.concat(
            F.lit('{"q":"'), F.repeat(F.lit("ab,: "), (i % 100).cast("int")), F.lit('","n":['), i.cast("string"), F.lit(",2]}")
        )
        two = F.array(call(i, "", "Search_Class", arguments), call(i, "b", "write_patch", F.lit("no json, really")))
        one = F.array(call(i, "", "view_file", F.lit("{}")))

        def answer(back: int, suffix: str, text: Column) -> Column:
            ref = F.concat(F.lit("c"), (i - back).cast("string"), F.lit(suffix))
            return _object(role=F.lit("tool"), tool_call_id=ref, content=text)

        return _by_kind(
            s, i,
            _object(role=F.lit("assistant"), tool_calls=two),
            answer(1, "", s), answer(2, "b", F.concat(s, F.lit(" Not Found"))),
            _object(role=F.lit("assistant"), content=s),
            _object(role=F.lit("user"), content=s),
            _object(role=F.lit("assistant"), content=s, tool_calls=one),
            answer(1, "", F.lit("later answer")),
        )

    docs = _sentences(spark, sf_dir)
    return _record(
        docs, _member("instance_id", _id()), _member("patch", F.lit('"  diff "')), _member("resolved", F.lit("false")),
        _member("trajectory", _list(F.transform("s", message))),
    )

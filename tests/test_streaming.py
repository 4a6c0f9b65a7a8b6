"""Streaming jobs, run to the end of their input and compared with their batch twins."""

import json

from pyspark.sql import functions as F

from stratadoc.operators import conversation
from stratadoc.operators.graph import gazetteer_extraction
from stratadoc.operators.rate_limit import rate_limit
from stratadoc.sources.keyed_log import newest
from stratadoc.sources.readers import stream_files
from stratadoc.streaming import arrivals, dedupe, events, rate_limit as live, states, write_back


def finish(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_arrivals_are_ingested_once(spark, tmp_path):
    source, root, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    gazetteer = spark.createDataFrame([("alpha", "Concept"), ("beta", "Concept"), ("gamma", "Concept")], "token string, type string")

    def extract(chunks):
        return gazetteer_extraction(chunks, gazetteer, ["doc_id", "chunk_index"])

    def run():
        finish(arrivals.start_ingest(stream_files(spark, str(source)), root, state, extract=extract))

    (source / "a.html").write_text("<p>alpha beta</p>")
    (source / "skip.log").write_text("alpha")
    run()
    (source / "b.txt").write_text("alpha, beta and gamma")
    (source / "c.pdf").write_bytes(b"%PDF")
    (source / "d.txt").write_bytes(b"caf\xe9")
    run()
    run()
    vectors = spark.read.parquet(f"{root}/vectors")
    assert sorted(r["filename"] for r in vectors.collect()) == ["a.html", "b.txt", "d.txt"]
    nodes = newest(spark.read.parquet(f"{root}/nodes"), "name")
    assert sorted(r["name"] for r in nodes.collect()) == ["alpha", "beta", "gamma"]
    edges = spark.read.parquet(f"{root}/edges").select("source", "target")
    assert sorted(tuple(r) for r in edges.collect()) == [("alpha", "beta"), ("beta", "gamma")]
    errors = spark.read.parquet(f"{root}/errors").collect()
    assert sorted((r["path"][-5:], r["_error"]) for r in errors) == [("c.pdf", "not parsed: pdf"), ("d.txt", "not UTF-8")]
    # A replayed batch leaves everything as it was.
    before = sorted(map(str, vectors.collect()))
    files = spark.read.format("binaryFile").load([str(source / name) for name in ("b.txt", "c.pdf", "d.txt")])
    arrivals.ingest_batch(files, 1, root, extract=extract)
    assert sorted(map(str, spark.read.parquet(f"{root}/vectors").collect())) == before


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts")
    table.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "ev"))
    names = {"key": "user_id", "ts": "ts", "event_id": "event_id", "limit": 2, "window_seconds": 86_400}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "ev"))
    query = (
        live.rate_limit_stream(stream, **names)
        .writeStream.format("memory").queryName("limited").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
    )
    finish(query)
    pairs = lambda df: sorted((r["event_id"], r["allowed"]) for r in df.collect())
    assert pairs(spark.table("limited")) == pairs(rate_limit(table, **names))


def test_rate_limit_stream_keeps_state_between_batches(spark, tmp_path):
    base = 1_700_000_000_000_000
    schema = "event_id long, client string, micros long"
    batches = [[(0, "a", base), (1, "a", base + 1)], [(2, "a", base + 2), (3, "a", base + 60_000_000)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros("micros"))
        query = (
            live.rate_limit_stream(stream, key="client", ts="ts", event_id="event_id", limit=2, forget_after="1 day")
            .writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
        )
        finish(query)
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_event_feed(spark, tmp_path):
    schema = "session_id string, seq int, node string, content string, failed boolean"
    rows = [("s", 0, "planner", None, False), ("s", 1, "responder", "done", False), ("t", 0, "planner", None, True)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    steps = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    finish(events.start_feed(steps, str(tmp_path / "out"), str(tmp_path / "st")))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    kinds = sorted((json.loads(x)["type"], json.loads(x).get("session_id")) for x in lines)
    assert kinds == [("answer", "s"), ("error", None), ("status", "s"), ("status", "s")] or set(kinds) == {
        ("answer", "s"), ("error", None), ("status", "s")
    }
    assert json.dumps({"type": "status", "node": "planner", "session_id": "s", "info": "Completed step: planner"}, separators=(",", ":")) in lines


def test_repeated_content_is_dropped(spark, tmp_path):
    schema = "path string, content string, at timestamp"
    rows = [("a", "same", "2024-01-01 00:00:00"), ("b", "same", "2024-01-01 01:00:00"), ("c", "other", "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "path string, content string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        dedupe.drop_repeats(stream, "content", "at").writeStream.format("memory").queryName("unique_content")
        .option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
    )
    finish(query)
    assert sorted(r["content"] for r in spark.table("unique_content").collect()) == ["other", "same"]


def test_write_back(spark, tmp_path):
    schema = "question_id string, session_id string, user_id string, question string, answer string, hit boolean"
    rows = [("1", "s", "u", "q1", "a1", False), ("2", "s", "u", "q2", "a2", True), ("3", "s", "u", "q3", "", False)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    finish(write_back.start_write_back(stream, str(tmp_path / "out"), str(tmp_path / "st")))
    history = spark.read.parquet(str(tmp_path / "out" / "history"))
    assert sorted((r["question_id"], r["role"], r["content"]) for r in history.collect()) == [
        ("1", "assistant", "a1"), ("1", "user", "q1"), ("2", "assistant", "a2"), ("2", "user", "q2"),
    ]
    cache = spark.read.parquet(str(tmp_path / "out" / "cache"))
    assert [(r["query"], r["answer"], len(r["embedding"])) for r in cache.collect()] == [("q1", "a1", 64)]


def test_states_of_a_stream_equal_the_batch(spark, tmp_path):
    """Steps in no order over several runs; only later steps overwrite a field; untouched states stay."""
    message = "array<struct<role:string,content:string>>"
    schema = f"q string, seq int, messages {message}, current_query string, documents array<string>"
    steps = [
        ("a", 3, [("user", "a3"), ("assistant", "a3b")], "third", ["x", "y"]),
        ("a", 1, [("user", "a1")], "first", ["z"]),
        ("b", 1, None, None, None),
        ("c", 5, [("system", None)], None, []),
        ("a", 2, [("user", "a2")], "second", None),
        ("b", 2, [("user", "b2")], "b", ["d"]),
    ]
    for rows in (steps[:3], steps[3:4], steps[4:]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        finish(states.start_states(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "q"))
    want = conversation.reduce_states(spark.createDataFrame(steps, schema), "q")
    got = states.current_states(spark, str(tmp_path / "out"), "q").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def notice(*keys):
    return (json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": k}}} for k in keys]}),)


def test_notified_keys_alone_are_ingested_once(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    (source / "deep").mkdir(parents=True)
    for name in ("a.html", "deep/b [1]*.txt", "c.txt", "never.txt", "skip.log"):
        (source / name).write_text(f"text of {name}")

    def run(*payloads):
        spark.createDataFrame(list(payloads), "payload string").coalesce(1).write.mode("append").text(str(tmp_path / "notes"))
        stream = spark.readStream.schema("value string").text(str(tmp_path / "notes")).withColumnRenamed("value", "payload")
        finish(arrivals.start_notified(stream, root, str(tmp_path / "cp"), str(source)))

    run(notice("a.html", "deep/b [1]*.txt", "a.html"), notice("a.html"), ("broken",))
    run(notice("c.txt", "a.html", "gone.txt", "skip.log"))
    run(notice("deep/b [1]*.txt"))
    vectors = spark.read.parquet(f"{root}/vectors")
    assert sorted(r["filename"] for r in vectors.collect()) == ["a.html", "b [1]*.txt", "c.txt"]
    assert [tuple(r) for r in spark.read.parquet(f"{root}/missing").select("path", "_error").collect()] == [("gone.txt", "no such file")]
    (source / "gone.txt").write_text("here now")
    run(notice("gone.txt", "c.txt"))
    assert spark.read.parquet(f"{root}/vectors").count() == 4
    # A replayed batch leaves everything as it was.
    arrivals.ingest_notified(spark.createDataFrame([notice("c.txt", "a.html", "gone.txt")], "payload string"), 1, root, str(source))
    assert spark.read.parquet(f"{root}/vectors").count() == 4

"""Readers, sinks and keyed tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stratadoc.operators import elements
from stratadoc.plans.ingest import ingest
from stratadoc.sources import keyed_log, keyed_store, readers, row_files, writers
from stratadoc.streaming import events as feed


def test_files_are_parsed_by_suffix(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text("<title>T</title><p>x</p>")
    (tmp_path / "in" / "deep" / "b.txt").write_text("plain ü")
    (tmp_path / "in" / "c.bin").write_text("no")
    files = readers.read_files(spark, str(tmp_path / "in"))
    assert files.count() == 2
    rows = {r["meta"]["filename"]: (r["text"], r["meta"]["type"], r["meta"]["title"]) for r in readers.parse_files(files).collect()}
    assert rows == {"a.html": ("T\nx", "html", "T"), "b.txt": ("plain ü", "txt", None)}
    root = str(tmp_path / "out")
    ingest(spark, str(tmp_path / "in"), root)
    points = spark.read.parquet(f"{root}/vectors")
    assert points.count() == 2 and points.where("page = 0").count() == 2


def test_sitemap(spark, tmp_path):
    (tmp_path / "map.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
        "<url><loc>https://h/a</loc><lastmod>x</lastmod></url><url><loc>https://h/b</loc></url><url><x/></url></urlset>"
    )
    rows = readers.read_sitemap(spark, str(tmp_path / "map.xml")).orderBy("pos").collect()
    assert [r["url"] for r in rows] == ["https://h/a", "https://h/b"]


def test_notifications(spark):
    event = {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": f"k{i}"}}} for i in range(2)]}
    df = spark.createDataFrame([(json.dumps(event),), ("{}",)], "payload string")
    assert [tuple(r) for r in readers.notification_rows(df).orderBy("key").collect()] == [("b", "k0"), ("b", "k1")]


def test_manifest_and_pages(spark, tmp_path):
    df = spark.createDataFrame([("s", "https://h/s", 'a "title"', "T\n=\n")], "slug string, url string, title string, text string")
    writers.write_manifest(df.coalesce(1), str(tmp_path / "m"))
    lines = next((tmp_path / "m").glob("*.csv")).read_text().splitlines()
    assert lines == ["slug\turl\ttitle", 's\thttps://h/s\ta "title"']
    writers.write_rendered(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "s.txt").read_text() == "T\n=\n"
    writers.write_rendered(df, str(tmp_path / "d"), suffix=".md", folders=4)
    assert next((tmp_path / "d").glob("[0-3]/s.md")).read_text() == "T\n=\n"


def test_events_are_lines_of_json(spark, tmp_path):
    hits = spark.createDataFrame([("s", "a\nb")], "session_id string, answer string")
    events = feed.cached_events(hits).select("event.*")
    writers.write_events(events, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()["value"] == '{"type":"answer","content":"a\\nb","session_id":"s"}'


def test_points_and_upsert(spark):
    chunks = spark.createDataFrame(
        [("f", 0, "h0", "t0", [1.0]), ("f", 1, "h1", "t1", None), ("f", 2, "h2", "t2", [])],
        "filename string, chunk_index int, chunk_hash string, text string, embedding array<float>",
    )
    points = writers.vector_points(chunks)
    assert points.count() == 1 and points.first()["page"] == 0
    # The same chunk ingested again keeps its point.
    assert writers.upsert(points, writers.vector_points(chunks), "point_id").count() == 1
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    got = sorted(tuple(r) for r in writers.upsert(old, new, "k", order="seq").collect())
    assert got == [("a", 1), ("b", 3), ("c", 4)]


def test_keyed_log_replay_and_compaction(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    like = rows(("x", 0))
    assert keyed_log.read_batches(spark, root, like).count() == 0
    keyed_log.append_batch(rows(("a", 1), ("b", 1)), root, 0)
    for _ in range(2):
        keyed_log.append_batch(rows(("b", 2), ("c", 2)), root, 1)
    newest = keyed_log.newest(keyed_log.read_batches(spark, root, like), "k")
    assert sorted(tuple(r) for r in newest.collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert keyed_log.read_batches(spark, root, like, before=1).count() == 2
    keyed_log.compact(spark, root, str(tmp_path / "new"), "k", like)
    assert keyed_log.read_batches(spark, str(tmp_path / "new"), like).count() == 3


def test_elements_of_a_long_document(spark):
    rows = [("d", i, "Table" if i % 100 == 7 else "Text", f"p{i}" if i % 10 else "  ", ["a", str(i)]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id string, seq int, category string, text string, cells array<string>").repartition(4)
    out = elements.assemble(df).first()
    assert out["text"] == "".join(r[3] + "\n" for r in rows) and (out["has_tables"], out["table_count"]) == (True, 7)
    flat = elements.flatten(df).first()
    kept = [r[3] for r in rows if r[2] != "Table" and r[3].strip()] + [" | ".join(r[4]) for r in rows if r[2] == "Table"]
    assert flat["text"] == "\n\n".join(kept) and flat["char_count"] == len(flat["text"])


def test_blank_document_stays(spark):
    df = spark.createDataFrame([("d", 0, "Text", " ", [])], "doc_id string, seq int, category string, text string, cells array<string>")
    assert tuple(elements.flatten(df).first()) == ("d", "", 0)


def test_parse_policy(spark):
    df = spark.createDataFrame([("a",), (None,)], "raw string")
    rows = elements.parse_or_fail(df, F.upper("raw"), mode="PERMISSIVE").collect()
    assert [(r["text"], r["_error"] is None) for r in rows] == [("A", True), (None, False)]
    with pytest.raises(Exception, match="could not be parsed"):
        elements.parse_or_fail(df, F.upper("raw")).collect()


def test_keyed_store_reads_only_its_buckets(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    store = keyed_store.KeyedStore(spark, str(tmp_path / "s"), ("k",), buckets=16)
    assert store.rows() is None and store.newest() is None and store.known(rows(("a", 1))).count() == 0
    first = rows(*[(f"k{i}", 0) for i in range(40)])
    assert store.append(first, 0) and not store.append(rows(("other", 9)), 0)  # a replay changes nothing
    assert store.append(rows(("k3", 1), ("new", 1)), 1) and not store.append(first.where("v > 5"), 2)
    assert {r["k"]: r["v"] for r in store.newest().collect()} == {f"k{i}": int(i == 3) for i in range(40)} | {"new": 1}
    assert sorted(r["k"] for r in store.known(rows(("k3", 0), ("new", 0), ("nobody", 0), ("k3", 0))).collect()) == ["k3", "new"]
    assert len(store.folders_with(rows(("k5", 0)))) == 1 and len(store.folders_with(rows(("k3", 0)))) == 2
    absent = rows(*[(f"z{i}", 0) for i in range(200)])
    assert len(store.folders_with(absent)) <= 2 and store.folders_with(absent, before=0) == []
    assert store.append_new(rows(("k3", 7), ("k7", 7), ("fresh", 7), ("fresh", 8)), 3)
    assert store.rows().where("batch_id = 3").count() == 1
    (tmp_path / "s" / "_manifest" / "3.json").unlink()  # not visible before its manifest stands
    assert store.rows().where("k = 'fresh'").count() == 0


def test_row_files_appear_together_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(row_files.RowFiles)
    folder = tmp_path / "files"
    rows = spark.createDataFrame([("a/b.txt", "ü"), ("c.txt", "x"), (None, "y"), ("d", None)], "name string, content string").repartition(3)
    rows.write.format("row_files").mode("append").save(str(folder))
    seen = lambda: sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not {"_commits", "_aborted"} & set(p.parts))
    assert seen() == ["a/b.txt", "c.txt"] and (folder / "a" / "b.txt").read_text() == "ü" and not list((folder / "_pending").iterdir())
    broken = spark.range(4).repartition(4).select(
        F.concat(F.lit("e"), "id").alias("name"), F.when(F.col("id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.lit("z")).alias("content")
    )
    with pytest.raises(Exception, match="stop"):
        broken.write.format("row_files").mode("append").save(str(folder))
    for _ in range(100):  # tasks that still ran may take a moment to see it
        if seen() == ["a/b.txt", "c.txt"]:
            break
        time.sleep(0.1)
    assert seen() == ["a/b.txt", "c.txt"]
    # A batch of a stream that is committed already is dropped when it is written again.
    writer = row_files.StreamFiles(str(folder))
    row = lambda name, content: {"name": name, "content": content}
    writer.commit([writer.write(iter([row("s.txt", "1")])), None], 7)
    again = row_files.StreamFiles(str(folder))
    again.commit([again.write(iter([row("s.txt", "2"), row("t.txt", "2")]))], 7)
    assert seen() == ["a/b.txt", "c.txt", "s.txt"] and (folder / "s.txt").read_text() == "1"


def test_row_files_of_a_stream(spark, tmp_path):
    spark.dataSource.register(row_files.RowFiles)
    for k in range(2):
        spark.createDataFrame([(f"{k}/{i}.txt", str(i)) for i in range(5)], "name string, content string").write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            spark.readStream.schema("name string, content string").parquet(str(tmp_path / "in")).writeStream.format("row_files")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert len(list((tmp_path / "out").glob("[01]/*.txt"))) == 5 * (k + 1)


def test_batches_of_python_workers_are_bounded(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

    assert max(r["id"] for r in spark.range(3_000).coalesce(1).mapInArrow(sizes, "id long").collect()) <= 1_000
    assert max(r["id"] for r in spark.range(30).selectExpr("id", "repeat('x', 2000000) AS text").coalesce(1).mapInArrow(sizes, "id long").collect()) < 30


def test_new_rows_of_a_store_are_written_once(spark, tmp_path, monkeypatch):
    """The first batch is stored as it comes; a later one is kept once while its keys are looked up."""
    from stratadoc.sources import keyed_store

    kept = []
    real = keyed_store.durable
    monkeypatch.setattr(keyed_store, "durable", lambda df: kept.append(1) or real(df))
    store = keyed_store.KeyedStore(spark, f"file://{tmp_path}/edges", ("a", "b"))
    rows = lambda *r: spark.createDataFrame(list(r), "a string, b long")
    assert store.append_new(rows(("x", 1), ("x", 1), ("y", 2), (None, 3)), 0) and len(kept) == 0
    assert store.append_new(rows(("x", 1), ("z", 4), ("z", 4), (None, 3)), 1) and len(kept) == 1
    stored = sorted(map(tuple, store.rows().select("a", "b", "batch_id").collect()), key=str)
    assert stored == sorted([("x", 1, 0), ("y", 2, 0), (None, 3, 0), ("z", 4, 1), (None, 3, 1)], key=str)


def test_keys_are_looked_up_by_tasks(spark, tmp_path, monkeypatch):
    names = ["a.html", "b [1]*.txt", "deep/c.txt"]
    (tmp_path / "deep").mkdir()
    for name in names:
        (tmp_path / name).write_text(name)
    keys = spark.createDataFrame([(n,) for n in [*names, *names, "gone.txt"]], "key string")
    asked = []
    own = readers._exists
    monkeypatch.setattr(readers, "_exists", lambda session, folder, untold: asked.extend(untold) or own(session, folder, untold))
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        files, missing = readers.read_keys(spark, folder, keys)
        assert sorted(bytes(r["content"]).decode() for r in files.collect()) == sorted(names) and missing == ["gone.txt"]
    assert asked == []
    # What tasks cannot tell the driver asks: a name that is too long, a store that Spark alone reaches.
    files, missing = readers.read_keys(spark, str(tmp_path), spark.createDataFrame([("x" * 300,), ("a.html",)], "key string"))
    assert files.count() == 1 and missing == ["x" * 300] == asked
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.keys.link./in", f"file://{tmp_path}")
    files, missing = readers.read_keys(spark, "viewfs://keys/in", keys)
    assert files.count() == len(names) and missing == ["gone.txt"] and len(asked) == 1 + len(names) + 1

"""Folders of many files are listed and read by tasks; the driver holds no name of them."""

import os
import pickle

from pyspark.sql import functions as F

from stratadoc import fixed_values as fv
from stratadoc.sources import readers, row_files

KEYS = ["a.html", "deep/b ü%20[1].txt", "deep/er/c.pdf", "x=1/d.txt", "_x=1/e.txt"]
LEFT_OUT = [".h.txt", "_h.txt", "_h/f.txt", ".h/f.txt", "g.HTML", "g.bin", "html", "i.txt._COPYING_"]


def put(folder, key, at=None):
    (folder / key).parent.mkdir(parents=True, exist_ok=True)
    (folder / key).write_text(key)
    if at is not None:
        os.utime(folder / key, (at, at))


def test_a_folder_is_read_as_by_spark(spark, tmp_path):
    folder = tmp_path / "in put"
    for key in KEYS + LEFT_OUT:
        put(folder, key)
    (folder / "empty").mkdir()
    (folder / "gone.txt").symlink_to(folder / "nothing.txt")
    (folder / "link").symlink_to(folder / "deep")
    own = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(fv.ACCEPTED_SUFFIXES) + "}").load(str(folder))
    )
    for name in (str(folder), f"{folder}/", f"file:{folder}"):
        files = readers.read_files(spark, name)
        assert sorted(map(tuple, files.collect())) == sorted(map(tuple, own.collect())) and files.count() == len(KEYS) + 2
        assert files.dtypes == own.dtypes
        # No scan that the driver plans by names of files.
        assert "binaryFile" not in files._jdf.queryExecution().optimizedPlan().toString()
    # A pattern, a file and a store that Spark alone reaches are left to Spark.
    assert readers.read_files(spark, f"{folder}/d*").count() == 2
    assert readers.read_files(spark, f"{folder}/a.html").count() == 1
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.folders.link./in", f"file://{tmp_path}")
    assert readers.read_files(spark, "viewfs://folders/in").count() == len(KEYS) + 2
    assert readers.read_files(spark, str(folder / "empty")).isEmpty()


def test_a_stream_follows_a_listing(spark, tmp_path):
    folder, listing = tmp_path / "in", str(tmp_path / "listing")
    for n in range(5):
        put(folder, f"{9 - n}.txt", 1_000 + n)
    put(folder, "_pending/x.txt")
    seen = []

    def run(state, most=2):
        before = len(seen)
        files = readers.stream_files(spark, str(folder), files_per_batch=most, listing=listing)
        query = files.writeStream.foreachBatch(lambda df, at: seen.append((at, sorted(bytes(r["content"]).decode() for r in df.collect()))))
        query = query.option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return seen[before:]

    # Oldest first, so many a batch, each once per checkpoint.
    assert run("s") == [(0, ["8.txt", "9.txt"]), (1, ["6.txt", "7.txt"]), (2, ["5.txt"])]
    assert run("s") == []
    put(folder, "deep/a.txt", 1)  # older than what was seen before
    put(folder, "deep/b.txt", 2)
    put(folder, "c.html", 3)
    assert run("s", 3) == [(3, ["c.html", "deep/a.txt", "deep/b.txt"])]
    # Another stream meets them all.
    assert sorted(k for _, keys in run("t") for k in keys) == sorted([f"{n}.txt" for n in range(5, 10)] + ["deep/a.txt", "deep/b.txt", "c.html"])


def test_a_writer_sends_no_names_to_the_driver(tmp_path):
    sizes = []
    for rows in (1, 500):
        writer = row_files.BatchFiles(str(tmp_path / str(rows)))
        message = writer.write(iter([{"name": f"d\n/{n} ü.txt", "content": "x"} for n in range(rows)]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert len(list((tmp_path / str(rows)).glob("d\n/*.txt"))) == rows
    assert max(sizes) < 1_000


def test_counts_of_an_ingest_with_a_listing(spark, tmp_path):
    """Batches of a listing are ingested like those of Spark's own source."""
    from stratadoc.streaming import arrivals

    for n in range(7):
        put(tmp_path / "in", f"{n}.txt")
    files = readers.stream_files(spark, str(tmp_path / "in"), files_per_batch=3, listing=str(tmp_path / "listing"))
    assert arrivals.start_ingest(files, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    counted = spark.read.parquet(str(tmp_path / "out" / "progress")).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["files"], r["points"]) for r in counted] == [(0, 3, 3), (1, 3, 3), (2, 1, 1)]
    assert spark.read.parquet(str(tmp_path / "out" / "vectors")).agg(F.count_distinct("filename")).first()[0] == 7

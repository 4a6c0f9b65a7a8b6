"""Folders of many files: listed by tasks, named in a table, read by tasks.

Spark's own file source keeps every name and the state of every file on the driver. Here the driver sees folders
level by level only as tables, and a stream follows parts of a listing, of which there are as many as batches.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratadoc.operators.numbering import dense_index
from stratadoc.schemas import RAW_FILE
from stratadoc.session import durable
from stratadoc.sources.row_files import file_system

#: Rows of a batch of listed names; bytes and rows of a batch of contents, whichever is reached first.
LISTED = 10_000
CONTENT_BYTES = 16 << 20
CONTENT_ROWS = 1_000


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder by its full name, and its path there; local names are no encoded addresses."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return file_system(root)


def walkable(spark: SparkSession, folder: str) -> str | None:
    """The full name of a folder that tasks can list by themselves; None for patterns, files and stores that Spark alone reaches."""
    if any(c in folder for c in "{}[]*?\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    try:
        store, at = _store(root)
        return root if store.get_file_info(at).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(store: fs.FileSystem, at: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether a folder, and time of change in milliseconds of what lies in one folder."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at or "/") as found:
            for entry in found:
                try:
                    yield entry.name, entry.is_dir(), entry.stat().st_mtime_ns // 1_000_000
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
    else:
        for info in store.get_file_info(fs.FileSelector(at)):
            yield info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 1_000_000


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    """``key, modified`` of files with one of the suffixes below a walkable folder; one table per level of folders."""
    ends = tuple(f".{s}" for s in suffixes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)

        def rows(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*held), (pa.string(), pa.bool_(), pa.int64()))], names=["key", "folder", "modified"]
            )

        held = []
        for batch in batches:
            for within in batch.column("key").to_pylist():
                for name, folder, modified in _entries(store, f"{base}/{within}" if within else base):
                    if not _hidden(name) and (folder or name.endswith(ends)):
                        held.append((f"{within}/{name}" if within else name, folder, modified))
                        if len(held) == LISTED:
                            yield rows(held)
                            held = []
        if held:
            yield rows(held)

    files, level = [], spark.createDataFrame([("",)], "key string")
    while True:
        spread_out = level.repartition(spark.sparkContext.defaultParallelism) if files else level
        seen = durable(spread_out.mapInArrow(look, "key string, folder boolean, modified long"))
        files.append(seen.where("not folder").select("key", "modified"))
        level = seen.where("folder").select("key")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)


def contents(names: DataFrame, root: str) -> DataFrame:
    """``path, modificationTime, length, content`` of files ``key`` below a folder, dealt out to tasks by name."""
    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)

        def rows(held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            held, size = [], 0
            for key in batch.column("key").to_pylist():
                with store.open_input_stream(f"{base}/{key}") as source:
                    content = source.read()
                changed = (store.get_file_info(f"{base}/{key}").mtime_ns or 0) // 1_000_000 * 1_000
                held.append((f"{root}/{key}", changed, len(content), content))
                size += len(content)
                if size >= CONTENT_BYTES or len(held) == CONTENT_ROWS:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    spark = names.sparkSession
    # A given number, since names are few and the contents are not: none are put together by size.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.select("key").repartition(tasks, "key").mapInArrow(read, RAW_FILE)


def list_new(spark: SparkSession, root: str, listing: str, suffixes: tuple[str, ...], files_per_part: int) -> int:
    """Add names not listed yet to ``listing/parts``, oldest first, as parts of so many names at most; how many parts.

    Parts appear one by one by renames, each a second later than the one before it, so that streams take them in
    order. A call that breaks off leaves a sound listing; the next one lists the rest. One call at a time.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    parts = path(f"{listing}/parts")
    store = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(parts)
    found = list_files(spark, root, suffixes)
    earlier = list(store.listStatus(parts))
    if earlier:
        known = spark.read.schema("key string").parquet(f"{listing}/parts")
        found = found.join(known, "key", "left_anti")
    numbered = dense_index(found, ["modified", "key"], "place", first=0)
    part = F.floor(F.col("place") / F.lit(files_per_part)).cast("int").alias("part")
    pending = f"{listing}/_pending/{uuid.uuid4().hex}"
    numbered.select("key", part).repartition("part").write.partitionBy("part").parquet(pending)
    written = []
    for folder in store.listStatus(path(pending)):
        name = folder.getPath().getName()
        if name.startswith("part="):
            written += [(int(name.removeprefix("part=")), file.getPath()) for file in store.listStatus(folder.getPath()) if file.getPath().getName().endswith(".parquet")]
    at = max([int(time.time() * 1_000), *(status.getModificationTime() + 1_000 for status in earlier)])
    for place, (_, file) in enumerate(sorted(written, key=lambda w: (w[0], w[1].getName()))):
        store.setTimes(file, at + 1_000 * place, -1)
        store.rename(file, path(f"{listing}/parts/{at:014d}-{place:06d}.parquet"))
    store.delete(path(pending), True)
    return len(written)


def stream_listed(spark: SparkSession, root: str, listing: str) -> DataFrame:
    """Files of a listing, one part a batch, each once per checkpoint."""
    names = spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).parquet(f"{listing}/parts")
    return contents(names, root)

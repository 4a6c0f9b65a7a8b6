"""Readers: raw files, notifications, sitemaps, and the parse step chosen by file suffix."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.html import clean_text, page_title
from stratadoc.functions.text import col, extension, filename
from stratadoc.schemas import DOC_META, NOTIFICATION, RAW_FILE
from stratadoc.sources import folders
from stratadoc.sources.row_files import file_system


#: A scan with as many tasks, a few GB, is left as it is however many cores there are.
SMALL_SCAN_TASKS = 16


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan dealt out to the cores.

    A small file with one row group is read by one task, which then also does all work per row. Any
    larger scan is left alone, so that no large table is shuffled with its texts.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SMALL_SCAN_TASKS)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = fv.ACCEPTED_SUFFIXES) -> DataFrame:
    """Every file below a path, as ``path, modificationTime, length, content``; tasks list a folder where they can."""
    root = folders.walkable(spark, path)
    if root is not None:
        return folders.contents(folders.list_files(spark, root, suffixes), root)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .load(path)
    )


def stream_files(
    spark: SparkSession,
    path: str,
    suffixes: tuple[str, ...] = fv.ACCEPTED_SUFFIXES,
    files_per_batch: int = 10_000,
    listing: str | None = None,
) -> DataFrame:
    """Files as they arrive, each once per checkpoint.

    Spark's source holds the state of every file on the driver. For large folders name a folder ``listing``, which
    belongs to the checkpoint and is kept as long: this call adds the names not listed yet, which tasks find, and the
    stream follows the listing, ``files_per_batch`` names at most a batch. A stream that stays up meets later
    arrivals when this, or ``folders.list_new``, is called again.
    """
    root = folders.walkable(spark, path) if listing is not None else None
    if root is not None:
        folders.list_new(spark, root, listing, suffixes, files_per_batch)
        return folders.stream_listed(spark, root, listing)
    return (
        spark.readStream.format("binaryFile")
        .schema(RAW_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def accepted(name: str, suffixes: tuple[str, ...] = fv.ACCEPTED_SUFFIXES) -> Column:
    """Whether a key has one of the accepted suffixes."""
    return F.lower(extension(filename(F.col(name), F.lit(0)))).isin(*suffixes)


#: Characters that make a path a pattern of paths.
PATTERN = re.compile(r"[{}\[\]*?\\]")


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """``key, there``: whether each key is a file below a folder, asked by the tasks; null where that cannot be told."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            store, root = file_system(folder)
        except (pa.ArrowException, OSError):  # a store that Spark alone reaches
            store, root = None, ""

        def there(name: str) -> bool | None:
            try:
                return store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound if store else None
            except (pa.ArrowException, OSError, ValueError):
                return None

        for batch in batches:
            found = pa.array([there(n) for n in batch.column("key").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key"), found], names=["key", "there"])

    spread_out = keys.select("key").distinct().repartition(keys.sparkSession.sparkContext.defaultParallelism)
    return spread_out.mapInArrow(look, "key string, there boolean")


def _exists(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Those of the names that are files below a folder, asked one by one by Spark's own file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in names if store.exists(path(f"{folder}/{n}"))]


def read_keys(spark: SparkSession, folder: str, keys: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Files of exactly the given keys below a folder, and keys without a file; nothing is listed.

    The names of a batch of keys come to the driver, since a scan is planned there; the batch bounds them.
    """
    looked = look_up(keys, folder).collect()
    untold = [r["key"] for r in looked if r["there"] is None]
    there = [r["key"] for r in looked if r["there"]]
    there = sorted(there + (_exists(spark, folder, untold) if untold else []))
    missing = sorted({r["key"] for r in looked}.difference(there))
    if not there:
        return None, missing
    paths = [f"{folder}/{n}" for n in there]
    parts = []
    # Names are taken as they are: a star or bracket in a key is no pattern. Where patterns are switched off, Spark
    # reads a path that is none twice, so only the others are read that way.
    for odd in (False, True):
        chosen = [p for p in paths if bool(PATTERN.search(p)) is odd]
        if chosen:
            reader = spark.read.format("binaryFile").schema(RAW_FILE)
            parts.append((reader.option("__globPaths__", "false") if odd else reader).load(chosen))
    return reduce(DataFrame.unionByName, parts), missing


PARSED = ("html", "htm", "txt")


def parse_files(files: DataFrame) -> DataFrame:
    """Documents from raw files: HTML is cleaned, text is taken as it is.

    The id is the md5 of the content, so the same file is the same document wherever it comes from.
    Bytes that are no UTF-8 become U+FFFD. Files that give no document are in :func:`parse_errors`.
    """
    name = filename("path", F.lit(0))
    kind = F.lower(extension(name))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    is_html = kind.isin("html", "htm")
    meta = F.struct(
        name.alias("filename"),
        F.when(is_html, F.lit("html")).otherwise(kind).alias("type"),
        F.when(is_html, page_title(raw)).alias("title"),
        F.lit(None).cast("boolean").alias("has_tables"),
        F.lit(None).cast("int").alias("table_count"),
        F.lit(None).cast("int").alias("char_count"),
    ).cast(DOC_META)
    return files.where(kind.isin(*PARSED)).select(
        F.md5("content").alias("doc_id"),
        F.when(is_html, clean_text(raw)).otherwise(raw).alias("text"),
        meta.alias("meta"),
    )


def parse_errors(files: DataFrame) -> DataFrame:
    """``path, _error`` of files that :func:`parse_files` leaves out or had to mend.

    Layout formats enter as an elements table instead.
    """
    kind = F.lower(extension(filename("path", F.lit(0))))
    error = F.when(~kind.isin(*PARSED), F.concat(F.lit("not parsed: "), kind)).when(
        ~F.is_valid_utf8(F.col("content").cast("string")), F.lit("not UTF-8")
    )
    return files.select("path", error.alias("_error")).where(F.col("_error").isNotNull())


def notification_rows(df: DataFrame, payload: str = "payload", *keep: str) -> DataFrame:
    """One ``bucket, key`` row per record of an upload notification."""
    records = F.from_json(col(payload), NOTIFICATION)["Records"]
    return df.select(*keep, F.explode(records).alias("_r")).select(
        *keep, F.col("_r.s3.bucket.name").alias("bucket"), F.col("_r.s3.object.key").alias("key")
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``pos, url`` of a sitemap's ``<url><loc>`` entries; ``pos`` grows in file order."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return rows.where(F.col("loc").isNotNull()).select(
        F.monotonically_increasing_id().alias("pos"), F.col("loc").alias("url")
    )

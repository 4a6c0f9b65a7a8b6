"""Documents that a parser delivers in elements: ingested when the last element of a file has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratadoc.operators.chunking import chunk, enrich, recursive_chunks
from stratadoc.operators.elements import assemble
from stratadoc.operators.embedding import embed_hashed
from stratadoc.session import durable
from stratadoc.sources.keyed_log import append_batch
from stratadoc.sources.keyed_store import KeyedStore
from stratadoc.sources.writers import POINT_KEY, vector_points


def elements_of_files(files: DataFrame, elements: DataFrame, delay: str = "1 day") -> DataFrame:
    """Elements joined with their file's row, whichever arrives first, within ``delay`` of each other.

    ``files`` is a stream of ``doc_id, filename, n_elements, at``, ``elements`` one of ``doc_id, seq, category,
    text, at``. Both watermarks let Spark forget rows that can no longer meet another.
    """
    left = files.withWatermark("at", delay)
    right = elements.withColumnsRenamed({"doc_id": "of", "at": "arrived"}).withWatermark("arrived", delay)
    near = f"doc_id = of and arrived between at - interval {delay} and at + interval {delay}"
    return left.join(right, F.expr(near)).select("doc_id", "filename", "n_elements", "seq", "category", "text")


def ingest_elements(rows: DataFrame, batch_id: int, root: str, embed: Callable[[DataFrame], DataFrame] = embed_hashed) -> None:
    """Store a batch's elements; chunk, embed and store the documents that are complete with it.

    Elements are kept by document, so a batch reads those of its own documents alone. A document is done once: its
    id goes to the ledger after its points are stored. An element that arrives twice counts once.
    """
    spark = rows.sparkSession
    parts, done = KeyedStore(spark, f"{root}/parts", ("doc_id",)), KeyedStore(spark, f"{root}/done", ("doc_id",))
    if rows.isEmpty() or done.has(batch_id):
        return
    rows = durable(rows)
    parts.append(rows, batch_id)
    touched = rows.select("doc_id").distinct()
    new = durable(touched.join(done.known(touched, batch_id), "doc_id", "left_anti"))
    held = durable(parts.matching(new).drop("batch_id").dropDuplicates(["doc_id", "seq"]))
    full = held.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_elements").alias("wanted"), F.first("filename").alias("filename"))
    full = durable(full.where("n >= wanted").select("doc_id", "filename"))
    whole = assemble(held.join(full.select("doc_id"), "doc_id", "left_semi")).join(full, "doc_id")
    chunks = enrich(chunk(whole.select("doc_id", "filename", "text"), recursive_chunks("text")), clock=False)
    append_batch(vector_points(embed(chunks.dropDuplicates(list(POINT_KEY)))), f"{root}/vectors", batch_id)
    done.append(full.select("doc_id"), batch_id)


def start_elements(files: DataFrame, elements: DataFrame, root: str, checkpoint: str, delay: str = "1 day", **steps) -> StreamingQuery:
    """Run :func:`ingest_elements` on both streams."""
    return (
        elements_of_files(files, elements, delay).writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: ingest_elements(df, batch_id, root, **steps))
        .trigger(availableNow=True)
        .start()
    )

"""Arrival-driven ingestion: new files become vectors and graph rows, each batch replay-safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratadoc.operators.chunking import chunk, enrich, recursive_chunks
from stratadoc.operators.embedding import embed_hashed
from stratadoc.operators.graph import explode_edges, explode_nodes, merge_edges, merge_nodes
from stratadoc.session import durable
from stratadoc.sources.keyed_log import append_batch
from stratadoc.sources.keyed_store import KeyedStore
from stratadoc.sources.readers import accepted, notification_rows, parse_errors, parse_files, read_keys
from stratadoc.sources.writers import POINT_KEY, vector_points
from stratadoc.streaming.progress import Counts


#: What a batch counts while it is written, in ``root/progress``.
PROGRESS = ("files", "documents", "chunks", "points")


def ingest_batch(
    files: DataFrame,
    batch_id: int,
    root: str,
    *,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One batch of files to ``root/vectors``, ``root/nodes``, ``root/edges`` and ``root/errors``.

    An empty batch writes nothing. An edge that an earlier batch stored is not stored again, and an
    edge's end points may come from any batch up to this one.

    ``embed`` adds an ``embedding`` column; ``extract`` turns chunks into
    ``doc_id, chunk_index, extraction`` rows. Chunks are checkpointed, since both branches read them. Files,
    documents, chunks and points are counted as they pass and stored in ``root/progress``.
    """
    spark = files.sparkSession
    if files.isEmpty():
        return
    seen, one = Counts(), F.lit(1)
    files = seen.on(files, files=F.count(one))
    append_batch(parse_errors(files), f"{root}/errors", batch_id)
    pieces = chunk(parse_files(files), recursive_chunks("text"))
    chunks = durable(seen.on(pieces, documents=F.count_if(F.col("chunk_index") == 0), chunks=F.count(one)))
    named = enrich(chunks, clock=False).withColumn("filename", F.col("meta.filename"))
    points = vector_points(embed(named.dropDuplicates(list(POINT_KEY))))
    append_batch(seen.on(points, points=F.count(one)), f"{root}/vectors", batch_id)
    counts = seen.values()
    append_batch(spark.createDataFrame([tuple(counts[c] for c in PROGRESS)], ", ".join(f"{c} long" for c in PROGRESS)), f"{root}/progress", batch_id)
    if extract is None:
        return
    extracted = durable(extract(chunks))
    names, links = graph_stores(spark, root)
    names.append(merge_nodes(explode_nodes(extracted, ["doc_id", "chunk_index"])), batch_id)
    edges = explode_edges(extracted)
    # Only folders that may hold the batch's own end points and edges are read, not the history.
    ends = names.known(edges.select(F.explode(F.array("source", "target")).alias("name")), batch_id + 1)
    links.append_new(merge_edges(edges, ends), batch_id)


def graph_stores(spark: SparkSession, root: str) -> tuple[KeyedStore, KeyedStore]:
    """Stores of nodes by name and of edges by all they are."""
    return KeyedStore(spark, f"{root}/nodes", ("name",)), KeyedStore(spark, f"{root}/edges", ("source", "target", "type"))


def start_ingest(files: DataFrame, root: str, checkpoint: str, available_now: bool = True, **steps) -> StreamingQuery:
    """Run :func:`ingest_batch` on a stream of files."""
    writer = (
        files.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: ingest_batch(df, batch_id, root, **steps))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_notified(notices: DataFrame, batch_id: int, root: str, folder: str, **steps) -> None:
    """Ingest exactly the keys that a batch of notifications names, each once.

    ``notices`` has ``payload``. Keys are taken below ``folder``, one per bucket and key; those in the ledger of
    done keys are left out, and no folder is listed. Keys without a file go to ``root/errors`` and may be notified again.
    The ledger is written last, so a batch that broke off is done again, over its own folders.
    """
    spark = notices.sparkSession
    ledger = KeyedStore(spark, f"{root}/done", ("bucket_name", "key"))
    if ledger.has(batch_id):
        return
    asked = notification_rows(notices).select(F.col("bucket").alias("bucket_name"), "key").where("key is not null").distinct()
    asked = durable(asked.where(accepted("key")))
    fresh = durable(asked.join(ledger.known(asked, batch_id), ["bucket_name", "key"], "left_anti"))
    files, missing = read_keys(spark, folder, fresh)
    if files is not None:
        ingest_batch(files, batch_id, root, **steps)
    if missing:
        lost = spark.createDataFrame([(m, "no such file") for m in missing], "path string, _error string")
        append_batch(lost, f"{root}/missing", batch_id)
        fresh = fresh.join(lost.select(F.col("path").alias("key")), "key", "left_anti").select("bucket_name", "key")
    ledger.append(fresh, batch_id)


def start_notified(notices: DataFrame, root: str, checkpoint: str, folder: str, **steps) -> StreamingQuery:
    """Run :func:`ingest_notified` on a stream of notification payloads."""
    return (
        notices.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: ingest_notified(df, batch_id, root, folder, **steps))
        .trigger(availableNow=True)
        .start()
    )

"""Sinks: vector points, cache entries, events, manifest and rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.functions.text import col, content_id
from stratadoc.functions.vectors import present
from stratadoc.sources.row_files import RowFiles


POINT_KEY = ("filename", "chunk_index", "chunk_hash")


def point_id(filename="filename", chunk_index="chunk_index", chunk_hash="chunk_hash") -> Column:
    """Key of a chunk: the same chunk of the same file keeps its point when it is ingested again."""
    return F.md5(F.concat_ws("\u0001", col(filename), col(chunk_index).cast("string"), col(chunk_hash)))


def vector_points(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Points of enriched chunks; rows without a vector are left out, a missing page is page 0."""
    page = F.col("page") if "page" in chunks.columns else F.lit(None)
    return chunks.where(present(vector)).select(
        point_id().alias("point_id"), vector, "text", "filename", F.coalesce(page, F.lit(0)).cast("int").alias("page")
    )


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Old rows without a new version, and the new rows; of several new rows the last wins."""
    if order is not None:
        last = new.groupBy(key).agg(F.max(order).alias(order))
        new = new.join(last, [key, order], "left_semi")
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def cache_entries(pairs: DataFrame, embed, query: str = "query", answer: str = "answer") -> DataFrame:
    """Cache rows of answered questions; an empty answer is not stored."""
    kept = pairs.where(F.coalesce(col(answer), F.lit("")) != "")
    return kept.select(
        content_id(query).alias("entry_id"),
        F.col(query).alias("query"),
        F.col(answer).alias("answer"),
        embed(query).alias("embedding"),
    )


def event_json(event="event") -> Column:
    """One JSON object per event; fields without a value are left out."""
    return F.to_json(col(event), {"ignoreNullFields": "true"})


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    events.select(event_json(F.struct(*events.columns)).alias("value")).write.mode(mode).text(path)


def write_manifest(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated ``slug, url, title`` with a header line."""
    (
        pages.select("slug", "url", "title")
        .write.mode(mode)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .csv(path)
    )


def write_rendered(pages: DataFrame, path: str, suffix: str = ".txt", folders: int = 0) -> None:
    """Rendered texts as files named by their slug, all of them or none.

    With ``folders``, files are dealt into that many numbered folders by a hash of the slug, so that no folder
    holds a whole large corpus.
    """
    pages.sparkSession.dataSource.register(RowFiles)
    name = F.concat("slug", F.lit(suffix))
    if folders:
        name = F.concat(F.pmod(F.xxhash64("slug"), F.lit(folders)).cast("string"), F.lit("/"), name)
    pages.select(name.alias("name"), F.col("text").alias("content")).write.format("row_files").mode("append").save(path)

"""Overlapping chunks, chunk metadata and removal of exact copies."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.text import col, content_id, let, strip


def fixed_windows(text, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Array of windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    text = col(text)
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    windows = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.filter(windows, lambda w: w != "")


def _pieces(text: Column, separator: str) -> Column:
    """Parts of a text, each but the first with the separator in front; characters for an empty separator."""
    if not separator:
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    parts = F.split(text, re.escape(separator), -1)
    joined = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(separator), part)))
    return F.filter(joined, lambda part: part != "")


def _split(text: Column, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    """Chunks of a text by its first separator; pieces still too long go on to the later ones.

    One fold over the pieces: consecutive short ones fill a chunk, of which at most ``overlap`` characters
    are carried over; a long one closes the chunk and is split on its own. The state holds places of pieces
    and the closed chunks; text is joined only when a chunk closes.
    """

    def over(pieces: Column) -> Column:
        def closed(state: Column) -> Column:
            held = F.slice(pieces, state["begin"] + 1, state["at"] - state["begin"])
            return F.filter(F.array(strip(F.array_join(held, ""))), lambda c: c != "")

        def state(at, begin, held, out) -> Column:
            return F.struct(at.alias("at"), begin.alias("begin"), held.alias("held"), out.alias("out"))

        def add(s: Column, piece: Column) -> Column:
            length = F.length(piece)

            def drop(t: Column, first: Column) -> Column:
                more = t["more"] & ((t["held"] > overlap) | ((t["held"] > 0) & (t["held"] + length > size)))
                return F.struct(
                    F.when(more, t["begin"] + 1).otherwise(t["begin"]).alias("begin"),
                    F.when(more, t["held"] - F.length(first)).otherwise(t["held"]).alias("held"),
                    more.alias("more"),
                )

            start = F.struct(s["begin"].alias("begin"), s["held"].alias("held"), F.lit(True).alias("more"))
            emptied = F.aggregate(
                F.slice(pieces, s["begin"] + 1, s["at"] - s["begin"]),
                start,
                drop,
                lambda t: state(s["at"] + 1, t["begin"], t["held"] + length, F.concat(s["out"], closed(s))),
            )
            full = (s["held"] + length > size) & (s["at"] > s["begin"])
            longer = _split(piece, size, overlap, separators[1:]) if len(separators) > 1 else F.array(piece)
            return (
                F.when(length >= size, state(s["at"] + 1, s["at"] + 1, F.lit(0), F.concat(s["out"], closed(s), longer)))
                .when(full, emptied)
                .otherwise(state(s["at"] + 1, s["begin"], s["held"] + length, s["out"]))
            )

        zero = state(F.lit(0), F.lit(0), F.lit(0), F.array().cast("array<string>"))
        return F.aggregate(pieces, zero, add, lambda s: F.concat(s["out"], closed(s)))

    return let(_pieces(text, separators[0]), over)


def recursive_chunks(
    text,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    separators: tuple[str, ...] = fv.SEPARATORS,
) -> Column:
    """Array of chunks by separators, as one expression; null for a null text.

    A separator that does not occur gives one piece, which goes on to the next separator if it is long.
    """
    return F.when(col(text).isNotNull(), _split(col(text), size, overlap, separators))


def chunk(df: DataFrame, chunks: Column, text: str = "text") -> DataFrame:
    """One row per chunk, numbered from 0 within its document; document columns are kept."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", text))


def enrich(chunks: DataFrame, text: str = "text", clock: bool = True) -> DataFrame:
    """Content hash, character length and, if wanted, the time of ingestion."""
    out = chunks.withColumn("chunk_hash", content_id(text)).withColumn("length", F.length(text))
    return out.withColumn("ingested_at", F.current_timestamp()) if clock else out


def first_copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Smallest key of every distinct text with the number of copies.

    Only hash and key are shuffled, after partial aggregation: a text that makes up a third of all
    rows leaves each task as one row.
    """
    return (
        df.groupBy(content_id(text).alias("chunk_hash"))
        .agg(F.min(key).alias(key), F.count("*").alias("copies"))
        .select(key, "chunk_hash", "copies")
    )


def drop_copies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Whole rows of the first copies."""
    return df.join(first_copies(df, key, text).select(key), key, "left_semi")

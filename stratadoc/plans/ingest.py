"""Batch ingestion of a folder of files into vector and graph tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratadoc.operators.embedding import embed_hashed
from stratadoc.sources.readers import read_files
from stratadoc.streaming.arrivals import ingest_batch


def ingest(
    spark: SparkSession,
    path: str,
    root: str,
    batch_id: int = 0,
    *,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Read every accepted file below ``path`` and store it as one batch under ``root``."""
    ingest_batch(read_files(spark, path), batch_id, root, embed=embed, extract=extract)

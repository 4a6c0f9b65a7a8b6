"""What the operators of this subpackage share: session settings, input columns, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratadoc.session import configure

#: Rows of text in one Arrow batch; with the byte limit of Spark it bounds a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and where each row begins (one more entry for the end).

    A null is an empty row. Arrow's buffers are used as they are; nothing is copied but for nulls.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return flat, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most_bytes`` of one text column; a longer text stands alone."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > most_bytes:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    if batch.num_rows > first:
        yield batch.slice(first, batch.num_rows - first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of slices ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)

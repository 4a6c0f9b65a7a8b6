"""Text to vector: a deterministic hashed bag of words, or any user model."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratadoc import fixed_values as fv
from stratadoc.functions.text import col
from stratadoc.functions.vectors import normalise


def hashed_vector(text, dim: int = fv.EMBED_DIM, unit: bool = True) -> Column:
    """Token counts per bucket, divided by their norm unless ``unit`` is off.

    Tokens are lower-cased runs of letters and digits of any script; the bucket is the number in the first eight hex digits
    of the token's md5, modulo the dimension. Built-in functions can say this only by passing over all
    tokens once per bucket, which took about twenty times as long, hence Arrow batches.
    """
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket_of = _Buckets(dim)
        for texts in batches:
            yield _hashed_rows(texts, bucket_of, unit)

    return embed(col(text))


def hashed_counts(text: str, dim: int = fv.EMBED_DIM) -> np.ndarray:
    """Token counts per bucket of one text."""
    buckets = [_Buckets(dim)[t] for t in re.findall(r"[^\W_]+", text.lower())]
    return np.bincount(np.array(buckets, dtype=np.int64), minlength=dim).astype(np.float64)


def _hashed_rows(texts: pa.Array, bucket_of: _Buckets, unit: bool) -> pa.Array:
    """Vectors of a batch of texts; the buckets of all texts are counted in one pass."""
    tokens, dim = re.compile(r"[^\W_]+").findall, bucket_of.dim
    found, sizes = array("q"), []
    for value in texts.to_pylist():
        buckets = [] if value is None else list(map(bucket_of.__getitem__, tokens(value.lower())))
        found.extend(buckets)
        sizes.append(len(buckets))
        bucket_of.trim()
    rows = len(sizes)
    place = np.repeat(np.arange(rows) * dim, sizes) + np.array(found, np.int64)
    counts = np.bincount(place, minlength=rows * dim).astype(np.float64).reshape(rows, dim)
    if unit:
        length = np.sqrt((counts * counts).sum(axis=1))
        length[length == 0] = 1.0
        counts /= length[:, None]
    limits = pa.array(np.arange(rows + 1) * dim, pa.int32())
    return pa.ListArray.from_arrays(limits, pa.array(counts.ravel()), mask=texts.is_null() if texts.null_count else None)


class _Buckets(dict):
    """Bucket per token, remembered while a task runs; a table of new words may not fill a worker's memory."""

    LARGEST = 50_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        value = self[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % self.dim
        return value

    def trim(self) -> None:
        if len(self) > self.LARGEST:
            self.clear()


def embed_hashed(df: DataFrame, text: str = "text", vector: str = "embedding", dim: int = fv.EMBED_DIM) -> DataFrame:
    return df.withColumn(vector, hashed_vector(text, dim))


def embed_with(
    df: DataFrame,
    make_model: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "text",
    vector: str = "embedding",
    batch_size: int = 32,
    mode: str = "FAILFAST",
    unit: bool = True,
) -> DataFrame:
    """Embed with a user model, built once per task and called on lists of ``batch_size`` texts.

    FAILFAST lets an error of the model fail the job; PERMISSIVE leaves the batch's vectors null, so
    that the rows drop out before they are stored.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode is FAILFAST or PERMISSIVE")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            out: list = []
            for start in range(0, len(texts), batch_size):
                part = texts.iloc[start : start + batch_size].tolist()
                try:
                    out.extend(list(map(float, v)) for v in model(part))
                except Exception:
                    if mode == "FAILFAST":
                        raise
                    out.extend([None] * len(part))
            yield pd.Series(out, dtype=object)

    embedded = df.withColumn(vector, run(col(text)))
    return embedded.withColumn(vector, normalise(vector)) if unit else embedded


def sound_and_failed(embedded: DataFrame, key: str, text: str = "text", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows with a vector, and dead letters ``key, _error`` of those whose text got none."""
    failed = embedded.where(F.col(vector).isNull() & F.col(text).isNotNull())
    return embedded.where(F.col(vector).isNotNull()), failed.select(key, F.lit("no embedding").alias("_error"))

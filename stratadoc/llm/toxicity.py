"""Toxicity classifier with counterfactual regularisation.

A text is the set of its byte n-grams of five and six bytes, A-Z lower-cased and all but letters read as
spaces, so that n-grams hold word limits. Features are the n-grams whose shares among toxic and other
training rows differ most. A logistic model is fitted on them; training texts that mention an identity
term are also taken with every such term swapped for another one of its group, and a change of the score
between both is penalised, so that the mention of a group is no sign of toxicity.

The training sample is bounded: about ``per_label`` labelled rows of each label, chosen by a hash of the
id against rates from the whole counts; rows are weighted back to the labels' true shares. Every text is
scored as a whole.

Defined results: a null or empty text has no features and gets the score of the bias alone; without
training rows of both labels every score is the share of toxic ones, 0 if there are none; labels other
than 0 and 1 are ignored, and a row labelled twice counts as toxic if one label says so; rows without an
id are scored but never learned from; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratadoc.llm.common import narrow, ready, slices, text_bytes
from stratadoc.llm.language import fold, training_rows
from stratadoc.llm.wordhash import LOWER

GRAMS = (5, 6)
HASH_BITS = 20
FEATURES = 1500
PER_LABEL = {0: 4000, 1: 2500}
LEAST_Z = 4.0
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 300
#: Bytes of text whose n-grams a worker holds at a time; they take about a hundred times as much memory.
SLICE_BYTES = 1 << 19

#: Terms of one line may stand for each other. A parameter; languages can be added line by line.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
)

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_PLAIN = _PLAIN[LOWER]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``rows, buckets`` of all n-grams of all texts, repeats included."""
    flat, at = text_bytes(column)
    sizes = np.diff(at)
    # Every text stands between spaces, and eight bytes from each place are read as one number.
    data = np.full(len(flat) + 2 * len(sizes) + 8, 0x20, np.uint8)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
    places = np.arange(len(flat)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1
    data[places] = _PLAIN[flat]
    wide = np.ndarray((len(row),), "<u8", data.data, strides=(1,))
    rows, buckets = [], []
    for size in GRAMS:
        n = max(len(row) - size + 1, 0)
        inside = row[:n] == row[size - 1 :]
        code = (wide[:n] & np.uint64((1 << 8 * size) - 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * size)
        rows.append(row[:n][inside])
        buckets.append((code >> np.uint64(64 - HASH_BITS)).astype(np.int32)[inside])
    return np.concatenate(rows), np.concatenate(buckets)


def presence(column: pa.Array, lookup: np.ndarray, width: int) -> np.ndarray:
    """Truth values of the chosen features, one row per text. ``lookup``: feature of a bucket, or -1."""
    rows, buckets = features(column)
    number = lookup[buckets]
    out = np.zeros((len(column), width), bool)
    out[rows[number >= 0], number[number >= 0]] = True
    return out


def swapper(terms: tuple[tuple[str, ...], ...]):
    """A function that swaps every identity term of a text for the next one of its group, None without any."""
    following = {t: group[(k + 1) % len(group)] for group in terms for k, t in enumerate(group) if len(group) > 1}
    if not following:
        return lambda text: None
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def swap(text: str | None) -> str | None:
        out, n = pattern.subn(lambda m: following[m[0].lower()], text or "")
        return out if n else None

    return swap


@dataclass(frozen=True)
class Model:
    """Chosen buckets, their weights and the bias, as a log-odds."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        out = np.full(1 << HASH_BITS, -1, np.int16)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def choose_features(sample: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Buckets whose shares among the labels differ most, from ``(text, toxic)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << HASH_BITS), np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                rows, buckets = features(batch.column("text"))
                pairs = np.unique(rows.astype(np.int64) << HASH_BITS | buckets)
                label = batch.column("toxic").to_numpy()[pairs >> HASH_BITS]
                for toxic in (0, 1):
                    totals[toxic] += np.bincount(pairs[label == toxic] & ((1 << HASH_BITS) - 1), minlength=1 << HASH_BITS)
        found = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(totals[0][found]), pa.array(totals[1][found])], names=["bucket", "clean", "toxic"]
        )

    size = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in size}
    if not n.get(0) or not n.get(1):
        return np.zeros(0, np.int64)
    counts = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / float(n[0] + n[1])
    deviation = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
    z = F.abs(F.col("toxic") / n[1] - F.col("clean") / n[0]) / deviation
    top = counts.select("bucket", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(most)
    return np.array([r["bucket"] for r in top.collect()], np.int64)


def fit(
    x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, pairs: np.ndarray, changed: np.ndarray,
    ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model.

    ``pairs[i]`` differs from the score of its text by ``pairs[i] @ weights`` when terms are swapped in
    text ``changed[i]``; the mean square of that, times ``counterfactual``, is part of the loss.
    """
    x, pairs = x.astype(np.float32), pairs.astype(np.float32)
    weight = weight / weight.sum()
    share = float((weight * toxic).sum())
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    w = np.zeros(x.shape[1], np.float32)
    moment, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        error = (weight * (p - toxic)).astype(np.float32)
        slope = x.T @ error + ridge * w
        if len(pairs):
            slope += counterfactual * (pairs.T @ (pairs @ w)) / len(pairs)
        gradient = np.append(slope, error.sum())
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.999 * spread + 0.001 * gradient**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return w.astype(np.float64), bias


def learn(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, per_label: dict[int, int] = PER_LABEL) -> Model:
    """A model from ``(doc_id, text)`` and ``(doc_id, toxic)``; both are read as a whole."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    chosen = [r for t, n in per_label.items() for r in training_rows(known.where(F.col("toxic") == t), "toxic", n, 2).collect()]
    if not shares.get(0) or not shares.get(1) or not chosen:
        share = shares.get(1, 0) / total if total else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    # At most the sum of per_label rows, give or take the chance of the hash.
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    sample = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    buckets = choose_features(sample)
    lookup = Model(buckets, np.zeros(0), 0.0).lookup()
    swap = swapper(terms)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                own = presence(batch.column("text"), lookup, len(buckets))
                swapped = [swap(t) for t in batch.column("text").to_pylist()]
                other = presence(pa.array([s or "" for s in swapped], pa.string()), lookup, len(buckets))
                bits = [[np.packbits(b).tobytes() for b in side] for side in (own, other)]
                bits[1] = [b if s is not None else None for b, s in zip(bits[1], swapped)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("toxic"), *[pa.array(b, pa.binary()) for b in bits]],
                    names=["doc_id", "toxic", "own", "other"],
                )

    rows = sample.mapInArrow(pack, "doc_id long, toxic int, own binary, other binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["own"]))

    def unpack(bits: list[bytes]) -> np.ndarray:
        return np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=len(buckets)) for b in bits], np.int8).reshape(len(bits), len(buckets))

    x = unpack([r["own"] for r in rows])
    toxic = np.array([r["toxic"] for r in rows])
    weight = np.array([shares[t] / max((toxic == t).sum(), 1) for t in toxic], float)
    changed = np.array([k for k, r in enumerate(rows) if r["other"] is not None], np.int64)
    pairs = unpack([rows[k]["other"] for k in changed]) - x[changed]
    weights, bias = fit(x, toxic, weight, pairs, changed)
    return Model(buckets, weights, bias)


def score(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Score of a whole text as a column."""
    shared = spark.sparkContext.broadcast((model.lookup(), model.weights, model.bias))

    # The types tell Spark that batches come as an iterator; names in text could not be resolved here.
    def rate(column):
        lookup, weights, bias = shared.value
        for texts in column:
            out = []
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
            for batch in slices(whole, "text", SLICE_BYTES):
                odds = presence(batch.column("text"), lookup, len(weights)) @ weights + bias
                out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    rate.__annotations__ = {"column": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(rate, "double")(F.col(text))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2,
    doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of the held-out fold are never read for learning."""
    ready(docs.sparkSession)
    docs = narrow(docs, doc_id=doc_id, text=text)
    labels = narrow(labels, doc_id=doc_id, toxic=toxic)
    model = learn(docs, labels.where(fold("doc_id", folds) != held))
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out")
    out = docs.withColumn("score", score(docs.sparkSession, model))
    return out.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

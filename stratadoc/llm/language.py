"""Language identification with blended-spectrum kernels.

A text is the set of its byte n-grams of one to three bytes, A-Z lower-cased: presence, not counts. The
kernel of two texts is the mean over the lengths of their shared n-grams, divided by the geometric mean
of their numbers of n-grams. Landmarks from the training sample span the kernel's Nyström approximation;
one-versus-rest kernel ridge regression is solved in it. Since the kernel is a product of presence
vectors, landmarks and coefficients fold into one matrix, and a batch is scored by one matrix product.

The training sample is bounded: about ``per_language`` labelled rows of every language, chosen by a hash of
the id against a rate from the languages' whole counts. Landmarks grow with the number of languages; once
they are fixed, tasks add up the normal equations of the sample.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if no
language was learned; rows without an id are never learned from; equal scores go to the language that
comes first in the alphabet; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratadoc.llm.common import narrow, ready, slices, text_bytes
from stratadoc.llm.wordhash import LOWER
from stratadoc.session import durable

#: Buckets of the presence sets of one, two and three bytes.
BUCKETS = (256, 4096, 8192)
WIDTH = sum(BUCKETS)
PER_LANGUAGE = 500
#: Landmarks in all, and of each language at least.
LANDMARKS = 400
LANDMARKS_PER_LANGUAGE = 8
#: Sample rows whose products a task adds up at a time.
FIT_ROWS = 256
RIDGE = 1e-2
UNDETERMINED = "und"
SLICE_BYTES = 2 << 20
SLICE_ROWS = 200
#: What Java and Python both take for a letter: the Unicode categories of letters.
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of category L; digits, fractions and numerals are none."""
    return any(unicodedata.category(c[0])[0] == "L" for c in _WORD.finditer(text or ""))


def presence(column: pa.Array) -> np.ndarray:
    """Truth values, one row per text, one column per bucket."""
    flat, at = text_bytes(column)
    data = LOWER[flat].astype(np.int64)
    rows = len(at) - 1
    row = np.repeat(np.arange(rows) * WIDTH, np.diff(at))
    out = np.zeros(rows * WIDTH, bool)
    out[row + data] = True
    if len(data) > 1:
        own = row[1:] == row[:-1]
        two = (data[:-1] * 181 + data[1:] * 31) % BUCKETS[1]
        out[(row[:-1] + BUCKETS[0] + two)[own]] = True
    if len(data) > 2:
        own = row[2:] == row[:-2]
        three = ((data[:-2] * 65_537 + data[1:-1] * 257 + data[2:]) * 40_503 >> 4) % BUCKETS[2]
        out[(row[:-2] + BUCKETS[0] + BUCKETS[1] + three)[own]] = True
    return out.reshape(rows, WIDTH)


def normalised(sets: np.ndarray) -> np.ndarray:
    """Presence divided so that a product of two rows is the kernel."""
    out = sets.astype(np.float32)
    first = 0
    for size in BUCKETS:
        part = out[:, first : first + size]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(BUCKETS))
        first += size
    return out


class Landmarks:
    """Nyström map that chosen presence sets span."""

    def __init__(self, sets: np.ndarray):
        self.chosen = normalised(sets).astype(np.float64)
        values, vectors = np.linalg.eigh(self.chosen @ self.chosen.T)
        real = values > 1e-8 * values.max()
        self.root = vectors[:, real] / np.sqrt(values[real])

    def mapped(self, sets: np.ndarray) -> np.ndarray:
        """Coordinates of presence sets, and a last one for the bias."""
        return np.concatenate([normalised(sets) @ (self.chosen.T @ self.root), np.ones((len(sets), 1))], axis=1)

    def sums(self, sets: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What these rows add to the normal equations: the inner products, then the targets' ones."""
        mapped = self.mapped(sets)
        weighted = mapped * weights[:, None]
        return weighted.T @ np.concatenate([mapped, targets], axis=1)

    def solve(self, sums: np.ndarray, rows: int, ridge: float = RIDGE) -> np.ndarray:
        """Matrix that turns normalised presence into one score per language; its last row is the bias."""
        size = len(sums)
        solved = np.linalg.solve(sums[:, :size] + ridge * rows * np.eye(size), sums[:, size:])
        return np.concatenate([self.chosen.T @ (self.root @ solved[:-1]), solved[-1:]]).astype(np.float32)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, label: str, per_label: int, most_labels: int | None = None) -> DataFrame:
    """Labelled rows, about ``per_label`` of each label: a rate per label, compared with a hash of the id."""
    ordered = docs.groupBy(label).count().orderBy(F.desc("count"), label)
    counts = (ordered.limit(most_labels) if most_labels else ordered).collect()
    if not counts:
        return docs.limit(0)
    rates = F.map_from_arrays(
        F.array(*[F.lit(row[label]) for row in counts]), F.array(*[F.lit(min(1.0, per_label / row["count"])) for row in counts])
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(1 << 20)
    return docs.where(place < F.try_element_at(rates, F.col(label)))


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.array([np.unpackbits(np.frombuffer(b, np.uint8), count=WIDTH) for b in bits]).reshape(len(bits), WIDTH)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """A model from documents ``(doc_id, text, lang)``: every language, and one score per language from presence.

    The driver holds the landmarks' bit sets and one matrix of the normal equations, which tasks add up.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                bits = np.packbits(presence(batch.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())],
                    names=["doc_id", "lang", "bits"],
                )

    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = durable(training_rows(usable, "lang", per_language).mapInArrow(pack, "doc_id long, lang string, bits binary"))
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((WIDTH + 1, 0), np.float32)
    each = max(LANDMARKS_PER_LANGUAGE, -(-LANDMARKS // len(names)))
    first = Window.partitionBy("lang").orderBy("doc_id", "bits")
    chosen = sample.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).orderBy("lang", "place").collect()
    landmarks = Landmarks(_unpacked([r["bits"] for r in chosen]))
    rows = sum(counts.values())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = None, {name: k for k, name in enumerate(names)}
        for whole in batches:
            for at in range(0, whole.num_rows, FIT_ROWS):
                batch = whole.slice(at, FIT_ROWS)
                own = np.array([number[x] for x in batch.column("lang").to_pylist()])
                targets = np.where(own[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
                # Rare languages count alike.
                weights = rows / np.array([counts[names[k]] for k in own], float)
                part = landmarks.sums(_unpacked(batch.column("bits").to_pylist()), targets, weights)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = None
    for row in sample.mapInArrow(add, "sums binary").toLocalIterator():
        part = np.frombuffer(row["sums"], np.float64)
        total = part.copy() if total is None else total + part
    return names, landmarks.solve(total.reshape(-1, len(total) // (landmarks.root.shape[1] + 1)), rows)


def predict(docs: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``(doc_id, text)``."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = model.value
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                for batch in slices(whole.slice(first, SLICE_ROWS), "text", SLICE_BYTES):
                    lettered = np.array([has_letter(t) for t in batch.column("text").to_pylist()])
                    best, value = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                    if names:
                        found = normalised(presence(batch.column("text"))) @ matrix[:-1] + matrix[-1]
                        best = found.argmax(axis=1)
                        value = np.clip((found.max(axis=1) + 1) / 2, 0, 1).astype(np.float64)
                    known = lettered & bool(names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id"),
                            pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                            pa.array(np.where(known, value, 0.0)),
                        ],
                        names=["doc_id", "lang_pred", "score"],
                    )

    return docs.mapInArrow(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held: int = 0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows of the held-out fold are never learned from."""
    ready(docs.sparkSession)
    docs = narrow(docs, doc_id=doc_id, text=text, lang=lang)
    names, weights = learn(docs.where(fold("doc_id", folds) != held))
    out = predict(docs.select("doc_id", "text"), names, weights)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")

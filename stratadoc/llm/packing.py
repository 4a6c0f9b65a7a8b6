"""Packing of whole documents into training windows by non-negative least squares.

Whole windows of a long document are sequences of their own. What is left of each document has a length
below the window; the histogram of these lengths has a bounded size whatever the corpus. Shallow
combinations of lengths that fill a window exactly are enumerated, their repeat counts are solved against
the histogram by non-negative least squares and rounded down so that no length is overdrawn. The residual
goes in descending length into further windows, each filled greedily and the last piece cut; the last
window is cut into powers of two, which need no padding.

Defined results: a null text is empty, so its document is the end id alone; rows with equal or null ids
are separate documents; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratadoc.llm.common import narrow, ready, slices
from stratadoc.llm.tokens import process_encoder
from stratadoc.session import durable

WINDOW = 4096
#: Frequent lengths that may stand in a combination of three or four.
COMMON_LENGTHS = 32
SOLVER_STEPS = 120
ENCODE_BYTES = 4 << 20
ENCODED = "part int, doc_id long, n long, tail int, tail_rank long, full_before long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def combinations(histogram: np.ndarray, window: int, common: int = COMMON_LENGTHS) -> np.ndarray:
    """Rows of up to four lengths, in descending order and filled up with 0, that sum to the window."""
    have = np.flatnonzero(histogram)
    frequent = have[np.argsort(-histogram[have], kind="stable")[:common]]
    exists = np.zeros(window + 1, bool)
    exists[have] = True
    exists[0] = True
    pairs = np.stack(np.meshgrid(have, np.append(frequent, 0), indexing="ij"), -1).reshape(-1, 2)
    few = frequent[: common // 4]
    triples = np.stack(np.meshgrid(have, few, few, indexing="ij"), -1).reshape(-1, 3)
    rows = np.concatenate([np.pad(pairs, ((0, 0), (0, 1))), triples]).astype(np.int64)
    rest = window - rows.sum(1)
    rows = np.concatenate([rows, np.maximum(rest, 0)[:, None]], 1)[(rest >= 0) & exists[np.clip(rest, 0, window)]]
    return np.unique(-np.sort(-rows, axis=1), axis=0).reshape(-1, 4)


def solve_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Whole repeat counts near the non-negative least-squares solution that overdraw no length.

    Multiplicative steps keep the counts non-negative and lower the squared error in each step.
    """
    target = histogram.astype(np.float64).copy()
    target[0] = 0
    real = rows > 0

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (x[:, None] * real).ravel(), len(target))

    pull = (target[rows] * real).sum(1)
    x = np.where(pull > 0, pull / np.maximum(real.sum(1), 1) / max(len(rows), 1), 0.0)
    for _ in range(steps):
        x *= pull / np.maximum((used(x)[rows] * real).sum(1), 1e-12)
    share = target / np.maximum(used(x), 1e-12)
    x *= np.minimum(np.where(real, share[rows], np.inf).min(1, initial=np.inf), 1.0)
    counts = np.floor(x + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64) - np.rint(used(counts)).astype(np.int64)
    # The rounding may leave whole combinations: the most wanted ones first, as often as the rest allows.
    for c in np.argsort(-(x - counts), kind="stable"):
        lengths, times = np.unique(rows[c][real[c]], return_counts=True)
        more = int((left[lengths] // times).min())
        if more > 0:
            counts[c] += more
            left[lengths] -= more * times
    return counts


@dataclass(frozen=True)
class Plan:
    """Where the documents of each length go; its size depends on the window alone."""

    window: int
    slot_from: np.ndarray  # per length, the first of its slots
    slot_rank: np.ndarray  # per slot, the first rank in it
    slot_sequence: np.ndarray
    slot_offset: np.ndarray
    placed: np.ndarray  # per length, documents in combinations
    residual_at: np.ndarray  # per length, ids of the residual before its first document
    residual_sequence: int
    cuts: np.ndarray  # limits inside the last residual window
    last_window: int
    full_sequence: int  # first sequence of the whole windows of long documents

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``start, length, sequence, offset`` of the pieces of the document with this rank."""
        if rank < self.placed[length]:
            a, b = self.slot_from[length], self.slot_from[length + 1]
            s = a + int(np.searchsorted(self.slot_rank[a:b], rank, "right")) - 1
            return [(0, length, int(self.slot_sequence[s] + rank - self.slot_rank[s]), int(self.slot_offset[s]))]
        at = int(self.residual_at[length] + (rank - self.placed[length]) * length)
        out, done = [], 0
        while done < length:
            number, offset = divmod(at + done, self.window)
            if number < self.last_window:
                sequence, end, begin = self.residual_sequence + number, self.window, 0
            else:
                k = int(np.searchsorted(self.cuts, offset, "right")) - 1
                sequence, begin, end = self.residual_sequence + number + k, int(self.cuts[k]), int(self.cuts[k + 1])
            size = min(length - done, end - offset)
            out.append((done, size, sequence, offset - begin))
            done += size
        return out


def make_plan(histogram: np.ndarray, window: int) -> Plan:
    """The plan for ``histogram[l]`` documents that have ``l`` ids left, ``l`` below the window."""
    histogram = np.concatenate([histogram, np.zeros(max(0, window + 1 - len(histogram)), np.int64)]).astype(np.int64)
    rows = combinations(histogram, window)
    counts = solve_counts(rows, histogram) if len(rows) else np.zeros(0, np.int64)
    rows, counts = rows[counts > 0], counts[counts > 0]
    first = np.cumsum(counts) - counts
    offsets = np.cumsum(rows, axis=1) - rows
    real = rows > 0
    length = rows[real]
    times = np.broadcast_to(counts[:, None], rows.shape)[real]
    order = np.argsort(length, kind="stable")
    length, times = length[order], times[order]
    ends = np.cumsum(times)
    placed = np.bincount(length, times, window + 1).astype(np.int64)
    rank = ends - times - (np.cumsum(placed) - placed)[length]
    slot_from = np.searchsorted(length, np.arange(window + 2))
    left = histogram - placed
    left[0] = 0
    sizes = left * np.arange(window + 1)
    residual_at = sizes.sum() - np.cumsum(sizes)  # longer lengths first
    last_window, rest = divmod(int(sizes.sum()), window)
    cuts, done = [0], 0
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            done += 1 << bit
            cuts.append(done)
    sequences = int(counts.sum())
    return Plan(
        window, slot_from, rank, np.broadcast_to(first[:, None], rows.shape)[real][order], offsets[real][order],
        placed, residual_at, sequences, np.array(cuts), last_window, sequences + last_window + len(cuts) - 1,
    )


def encode_tails(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Ids of ``(doc_id, text)``, with running numbers inside each task, stored in the shared folder.

    ``tail_rank`` counts earlier documents of the task with the same tail, ``full_before`` its earlier
    whole windows. Stored rows keep these numbers if an executor is lost later.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_encoder(tokenizer, "drop")
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        full = 0
        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                ids, counts = encoder.encode(batch.column("text"), end_id)
                data = ids.astype(f"<u{encoder.width}").tobytes()
                ends = np.cumsum(counts) * encoder.width
                tails = counts % window
                ranks = np.empty(len(tails), np.int64)
                for row, tail in enumerate(tails.tolist()):
                    ranks[row] = seen[tail]
                    seen[tail] += 1
                windows = counts // window
                before = full + np.cumsum(windows) - windows
                full += int(windows.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), part, np.int32)),
                        batch.column("doc_id"),
                        pa.array(counts.astype(np.int64)),
                        pa.array(tails.astype(np.int32)),
                        pa.array(ranks),
                        pa.array(before),
                        pa.array([data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary()),
                    ],
                    names=["part", "doc_id", "n", "tail", "tail_rank", "full_before", "ids"],
                )

    return durable(docs.mapInArrow(encode, ENCODED))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: its place in its document and its place in a sequence."""
    ready(docs.sparkSession)
    encoded = encode_tails(narrow(docs, doc_id=doc_id, text=text), tokenizer, end_id, window)
    per_part = encoded.groupBy("tail", "part").agg(F.count("*").alias("rows"))
    found = per_part.groupBy("tail").agg(F.sum("rows").alias("rows")).collect()  # fewer rows than the window
    histogram = np.zeros(window + 1, np.int64)
    for row in found:
        histogram[row["tail"]] = row["rows"]
    plan = make_plan(histogram, window)

    earlier = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tails = per_part.select("tail", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rank_ahead"))
    # One row per task of the encoding.
    sums = encoded.groupBy("part").agg(F.sum(F.expr(f"n div {window}")).alias("windows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("windows").over(ahead), F.lit(0)).alias("full_ahead"))
    numbered = encoded.join(tails.join(parts, "part"), ["tail", "part"]).select(
        "doc_id",
        "n",
        "tail",
        (F.col("tail_rank") + F.col("rank_ahead")).alias("rank"),
        (F.col("full_before") + F.col("full_ahead")).alias("full"),
        "ids",
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n", "tail", "rank", "full")]
            for row, (doc, n, tail, rank, full) in enumerate(zip(*columns)):
                stored = batch.column("ids")[row].as_buffer()
                ids = np.frombuffer(stored, f"<u{stored.size // n}").astype("<u4")
                pieces = [(w * window, window, plan.full_sequence + full + w, 0) for w in range(n // window)]
                if tail:
                    pieces += [(n - tail + a, size, s, o) for a, size, s, o in plan.place(tail, rank)]
                out += [(doc, a, size, zlib.crc32(ids[a : a + size].tobytes()), n, s, o) for a, size, s, o in pieces]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return numbered.mapInArrow(place, PIECES)

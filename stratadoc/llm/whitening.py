"""Whitened principal components of a table of vectors, by spectral divide and conquer.

Three passes over the vectors, each a sum that Spark adds up: counts and exact sums, the covariance centred
before multiplying, and the covariance of the whitened rows as a check. Between them the driver holds one
matrix of the vectors' dimension, whatever the number of rows.

Its eigenvectors come from polar decompositions. The unitary polar factor of ``V - shift`` is the sign of
``V - shift``, so half its sum with the identity projects on the components above the shift. The factor is
found by dynamically weighted Halley steps in QR form; orthonormal bases of the projector and of its
complement split the matrix into two smaller ones, and so on down to single components. The whitening matrix
is broadcast with the tasks.

Defined results: a row without a vector, or whose vector is empty or holds null or non-finite entries, is left out;
so are vectors whose length is not the table's most frequent one (of equals, the smallest). Entries whose
64-fold leaves 2 to the power of 40 count as that limit. Components whose eigenvalue double precision does
not resolve to ``RESOLVED`` beside the largest one cannot be whitened and are not returned, so a table of one
row, of copies, or an empty one, gives no rows. A deviation beyond the range of long is null. Rows with equal ids are vectors of their own; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratadoc.llm.common import narrow, ready

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
LIMIT = 1 << 40
EPSILON = float(np.finfo(np.float64).eps)
RESOLVED = 1e-5
MOST_STEPS = 30
MOST_SHIFTS = 40


def polar_sign(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix, by weighted Halley steps with QR decompositions."""
    size = len(a)
    scale = float(np.linalg.norm(a))
    x = a / scale
    # Lower bound of the smallest singular value; a bound that is too small only costs steps.
    low = EPSILON
    for _ in range(MOST_STEPS):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        h = math.sqrt(1 + d) + math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)), 0.0)) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(size)]))
        step = b / c * x + (h - b / c) / math.sqrt(c) * (q[:size] @ q[size:].T)
        step = (step + step.T) / 2
        moved = float(np.linalg.norm(step - x))
        x = step
        low = min(1.0, low * (h + b * low**2) / (1 + c * low**2))
        if 1 - low < 10 * EPSILON and moved <= 100 * EPSILON * math.sqrt(size):
            break
    return x


def _basis(projector: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Orthonormal basis of the range of a projector."""
    q = np.random.default_rng(seed).standard_normal((len(projector), rank))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces; None if all components are equal to double precision."""
    size = len(a)
    norm = float(np.linalg.norm(a))
    centre = float(np.trace(a)) / size
    spread = float(np.linalg.norm(a - centre * np.eye(size)))
    if spread <= 8 * EPSILON * norm:
        return None
    # All components lie within the spread of the centre and not all on one side of it.
    low, high = centre - spread, centre + spread
    shift = centre
    best = None
    for attempt in range(MOST_SHIFTS):
        sign = polar_sign(a - shift * np.eye(size))
        upper = (np.eye(size) + sign) / 2
        rank = round(float(np.trace(upper)))
        if 0 < rank < size:
            bases = _basis(upper, rank, attempt), _basis(np.eye(size) - upper, size - rank, attempt)
            left = float(np.linalg.norm(bases[0].T @ a @ bases[1]))
            if best is None or left < best[0]:
                best = left, bases
            if left <= 16 * EPSILON * norm * size:
                break
            # The shift stands on a component; one a little further off separates better.
            shift += spread * (0.01 if attempt % 2 else -0.02) * (attempt + 1)
        elif rank == 0:
            high, shift = shift, (low + shift) / 2
        else:
            low, shift = shift, (shift + high) / 2
    return best[1] if best else None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    done = []
    waiting = [np.eye(len(v))]
    while waiting:
        q = waiting.pop()
        if q.shape[1] == 1:
            done.append(q)
            continue
        a = q.T @ v @ q
        parts = _split((a + a.T) / 2)
        if parts is None:
            done.append(q)
        else:
            waiting += [q @ part for part in parts]
    q = np.linalg.qr(np.hstack(done))[0]
    for _ in range(2):
        q = _refined(v, q)
    order = np.argsort(-np.einsum("ij,ij->j", q, v @ q), kind="stable")
    # From the largest on, so that what rounding left of it goes from the smaller ones.
    q = np.linalg.qr(q[:, order])[0]
    return np.einsum("ij,ij->j", q, v @ q), q


def _refined(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One step that takes approximate eigenvectors to nearly twice as many right digits."""
    r = np.eye(len(v)) - q.T @ q
    s = q.T @ v @ q
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    close = 2 * (np.linalg.norm(s - np.diag(values)) + np.linalg.norm(v) * np.linalg.norm(r))
    apart = np.abs(gap) > close
    return q + q @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as whole numbers, one row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64) + OFFSET


class Centre:
    """Count and exact sums of the fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        base = [s // n for s in sums]
        self.base = np.array(base, np.int64)
        self.rest = np.array([s - n * b for s, b in zip(sums, base)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - S) ** 2``, exact."""
        away = x - self.base
        largest = self.n * (float(np.abs(away).max(initial=0)) + 1)
        if largest**2 * x.shape[1] < 2**62:
            return ((self.n * away - self.rest) ** 2).sum(axis=1).tolist()
        sums = ((self.n * away.astype(object) - self.rest) ** 2).sum(axis=1)
        return [int(s) if s < 2**63 else None for s in sums]


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    """Upper triangle of a symmetric matrix as rows ``i, j, value``."""
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(matrix[i, j])], names=["i", "j", "value"])


def _summed(rows: DataFrame, task, dim: int) -> np.ndarray:
    """Sum over all tasks of a symmetric matrix that each adds up."""
    total = rows.mapInArrow(task, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((dim, dim))
    i, j = (total.column(c).to_numpy() for c in ("i", "j"))
    out[i, j] = total.column("value").to_numpy()
    out[j, i] = out[i, j]
    return out


def _centre(rows: DataFrame, dim: int) -> Centre:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("embedding"), dim)
            places = pa.array(np.arange(dim))
            yield pa.RecordBatch.from_arrays([places, pa.array(np.full(dim, len(x))), pa.array(x.sum(axis=0))], names=["i", "n", "total"])

    parts = rows.select("embedding").mapInArrow(add, "i long, n long, total long")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    return Centre(int(sums[0]["n"]), [int(r["total"]) for r in sums])


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per sound row and component."""
    spark = ready(vectors.sparkSession)
    rows = narrow(vectors, vec_id=vec_id, embedding=embedding)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size("embedding") > 0) & finite)
    usual = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = rows.where(F.size("embedding") == dim)
    centre = _centre(rows, dim)

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            y = centre.centred(whole(batch.column("embedding"), dim))
            total += y.T @ y
        yield _cells(total)

    v = _summed(rows.select("embedding"), covariance, dim) / centre.n
    values, directions = eigen(v)
    wanted = int((values[:components] > dim * EPSILON / RESOLVED * max(values[0], 0.0)).sum())
    if wanted == 0:
        return spark.createDataFrame([], schema)
    weights = directions[:, :wanted] / np.sqrt(values[:wanted])
    explained = values[:wanted] / np.trace(v)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row and column add up the whitened values themselves, to centre them.
        total = np.zeros((wanted + 1, wanted + 1))
        for batch in batches:
            w = centre.centred(whole(batch.column("embedding"), dim)) @ weights
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        yield _cells(total)

    second = _summed(rows.select("embedding"), checked, wanted + 1) / centre.n
    mean = second[wanted, :wanted]
    error = float(np.abs(second[:wanted, :wanted] - np.outer(mean, mean) - np.eye(wanted)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("embedding"), dim)
            each = np.repeat(np.arange(len(x)), wanted)
            count = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, centre.n)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array((centre.centred(x) @ weights).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)

"""What one task of a ranked scan does with its block: score, keep the best k per question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Questions and items of one tile, whose scores stay in a core's cache.
TILE = 512
ITEMS = 1_024
#: Pairs that are held at least before they are merged into the best ones, unless a stretch ends.
HELD = 65_536


def _ids(array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _one_array(column):
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    return column


def _matrix(column) -> np.ndarray:
    """List column to a float64 matrix; all lists must have one length."""
    column = _one_array(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimension in one table")
    return flat.reshape(rows, -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; the squares are added in index order."""
    square = np.zeros(len(matrix))
    for d in range(matrix.shape[1]):
        square += matrix[:, d] * matrix[:, d]
    length = np.sqrt(square)
    length[length == 0] = 1.0
    return matrix / length[:, None]


class _Best:
    """Best k (score, id) per question so far."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.score = np.full((questions, k), -np.inf)
        self.ids: np.ndarray | None = None
        self.floor = np.full(questions, -np.inf)

    def merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        if self.ids is None:
            self.ids = np.empty(self.score.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        # Only questions with something new are looked at again.
        asked = np.unique(q)
        row, col = np.nonzero(self.score[asked] > -np.inf)
        row = asked[row]
        q = np.concatenate([row, q])
        score = np.concatenate([self.score[row, col], score])
        ids = np.concatenate([self.ids[row, col], ids])
        order = np.lexsort((-score, q))
        q, score, ids = q[order], score[order], ids[order]
        # Ids may be strings, slow to sort, so they are compared among equal scores alone.
        same = (q[1:] == q[:-1]) & (score[1:] == score[:-1])
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if len(tied):
            ids[tied] = ids[tied][np.lexsort((ids[tied], -score[tied], q[tied]))]
        first = np.r_[True, q[1:] != q[:-1]]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = place < self.k
        q, score, ids, place = q[keep], score[keep], ids[keep], place[keep]
        self.score[q, place], self.ids[q, place] = score, ids
        full = place == self.k - 1
        self.floor[q[full]] = score[full]

    def all(self, qids: np.ndarray):
        """Question ids, item ids and scores."""
        if self.ids is None:
            return np.empty(0, dtype=object), np.empty(0, dtype=object), np.empty(0)
        row, col = np.nonzero(self.score > -np.inf)
        return qids[row], self.ids[row, col], self.score[row, col]


def _best_columns(scores: np.ndarray, k: int, digits: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best k cells of each row; of equal scores the earlier columns win."""
    rows, width = scores.shape
    if width <= k:
        cols = np.broadcast_to(np.arange(width), (rows, width))
    else:
        # Integer rank key, different for every column of a row.
        key = np.rint(np.maximum(scores, -2.0) * digits).astype(np.int64) * width + np.arange(width - 1, -1, -1)
        cols = np.argpartition(key, width - k, axis=1)[:, -k:]
    return np.repeat(np.arange(rows), cols.shape[1]), cols.ravel()


class CosineKernel:
    """Exact cosine top-k by matrix products.

    Products in single precision find the pairs that may reach a question's floor, the score of its k-th best
    so far; these alone are scored in double precision. Scores are rounded to nine decimals before ranking, so
    a pair has the same score in whatever block it is met and copies of one vector tie. Items are taken in id
    order, so ties go to smaller ids.
    """

    DIGITS = 1e9

    def __init__(self, table, *, question_id, item_id, vector, k, threshold, skip_same, match_on, cells=None):
        self.qids = _ids(table[question_id])
        self.q = _unit(_matrix(table[vector]))
        self.single = self.q.astype(np.float32)
        # What single precision may be off: every factor, product and sum is rounded once.
        self.slack = (self.q.shape[1] + 8) * 2.0**-23 + 1 / self.DIGITS
        self.wanted = _ids(table[match_on]) if match_on else None
        self.names = (item_id, vector, match_on)
        self.k, self.threshold, self.skip_same = k, threshold, skip_same
        self.top = _Best(len(self.qids), k)
        self.rows = np.arange(len(self.qids))
        self.cells = cells
        self.scored = 0
        if cells is not None and len(self.qids):
            self._start(cells["sample"])

    def _start(self, sample) -> None:
        """Floors from the sampled items, which are items themselves, and the cells' centres."""
        ids, self.centres = _ids(sample.column(self.names[0])), _unit(_matrix(sample.column(self.names[1])))
        match = _ids(sample.column(self.names[2])) if self.names[2] else None
        for at in range(0, len(self.rows), TILE):
            rows = self.rows[at : at + TILE]
            scores = self.q[rows] @ self.centres.T
            self._mask(rows, scores, ids, match)
            if scores.shape[1] >= self.k:
                best = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
                found = best > -np.inf
                self.top.floor[rows[found]] = np.floor(best[found] * self.DIGITS + 0.5) / self.DIGITS

    def _unmatched(self, rows: np.ndarray, match: np.ndarray) -> np.ndarray:
        wanted = self.wanted[rows]
        free = np.array([w is None or w != w for w in wanted], bool)
        return ~free[:, None] & (wanted[:, None] != match[None, :])

    def _mask(self, rows: np.ndarray, scores, ids, match) -> None:
        if self.skip_same:
            scores[self.qids[rows, None] == ids[None, :]] = -np.inf
        if match is not None:
            scores[self._unmatched(rows, match)] = -np.inf

    def _floor(self, rows: np.ndarray) -> np.ndarray:
        floor = self.top.floor[rows]
        return floor if self.threshold is None else np.maximum(floor, self.threshold)

    def _near(self, cell: int) -> np.ndarray:
        """Whether questions may reach their floor in a cell: no item is nearer than its centre less the radius."""
        centre, radius = self.q @ self.centres[cell], min(self.cells["radius"][cell], np.pi)
        across = np.sqrt(np.maximum(1.0 - centre * centre, 0.0))
        nearest = np.where(centre >= np.cos(radius), 1.0, centre * np.cos(radius) + across * np.sin(radius))
        return nearest >= self._floor(self.rows) - 2 / self.DIGITS

    def _stretches(self, cell: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Stretches of items, sorted by cell, and the questions they are scored for.

        Small cells go together if most of the pairs of all their questions and items are wanted anyway.
        """
        if self.cells is None:
            yield 0, len(cell), self.rows
            return
        limits = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1)).tolist()
        at = 0
        while at < len(limits) - 1:
            end = at + 1
            while end < len(limits) - 1 and limits[end + 1] - limits[at] <= ITEMS:
                end += 1
            some, pairs = np.zeros(len(self.rows), bool), 0
            for first, last in zip(limits[at:end], limits[at + 1 : end + 1]):
                near = self._near(int(cell[first]))
                some |= near
                pairs += np.count_nonzero(near) * (last - first)
            if end == at + 1 or 2 * pairs > np.count_nonzero(some) * (limits[end] - limits[at]):
                yield limits[at], limits[end], self.rows[some]
            else:
                for first, last in zip(limits[at:end], limits[at + 1 : end + 1]):
                    yield first, last, self.rows[self._near(int(cell[first]))]
            at = end

    def update(self, batch) -> None:
        item_id, vector, match_on = self.names
        # Items without a vector go here: a filter before the scan would have Spark work out every vector twice.
        lengths = pc.fill_null(pc.list_value_length(_one_array(batch.column(vector))), 0)
        if pc.min(lengths).as_py() == 0:
            batch = batch.filter(pc.greater(lengths, 0))
        if not batch.num_rows or not len(self.qids):
            return
        v = _unit(_matrix(batch.column(vector)))
        if v.shape[1] != self.q.shape[1]:
            raise ValueError("questions and items have different vector dimensions")
        ids = _ids(batch.column(item_id))
        cell = _ids(batch.column("_cell")) if self.cells is not None else np.zeros(len(ids), np.int32)
        order = np.lexsort((ids, cell))
        v, ids, cell = v[order], ids[order], cell[order]
        single = v.astype(np.float32)
        match = _ids(batch.column(match_on))[order] if match_on else None
        for first, last, rows in self._stretches(cell):
            for start in range(first, last, ITEMS):
                span = slice(start, min(start + ITEMS, last))
                own = None if match is None else match[span]
                # Tiles of one stretch hold different questions, so what they find goes in together.
                found, size = [], 0
                for at in range(0, len(rows), TILE):
                    found.append(self._tile(rows[at : at + TILE], v[span], single[span], ids[span], own))
                    size += len(found[-1][0])
                    if size >= HELD or at + TILE >= len(rows):
                        self.top.merge(*map(np.concatenate, zip(*found)))
                        found, size = [], 0

    def _tile(self, rows: np.ndarray, v, single, ids, match) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question rows, scores and ids of pairs that reach their question's floor."""
        self.scored += len(rows) * len(ids)
        floor, asked = self._floor(rows), len(rows)
        # Neighbouring questions are taken where they are, others are copied.
        near_by = slice(rows[0], rows[-1] + 1) if rows[-1] - rows[0] + 1 == asked else rows
        rough, least = self.single[near_by] @ single.T, (floor - self.slack).astype(np.float32)
        # Most questions have nothing near their floor in a tile. Only those that may are looked at pair by pair;
        # a largest score that is no number says nothing of the others.
        near = ~(rough.max(axis=1) < least)
        if not near.all():
            rows, floor, rough, least = rows[near], floor[near], rough[near], least[near]
        hit = rough >= least[:, None]
        if match is not None:
            hit &= ~self._unmatched(rows, match)
        # Questions without k good items yet, or with a crowd of them, take the tile's own best k.
        crowd = floor <= -2
        if np.count_nonzero(hit) > 8 * self.k * asked:
            crowd = crowd | (np.count_nonzero(hit, axis=1) > 8 * self.k)
        hit[crowd] = False
        row, col = np.divmod(np.flatnonzero(hit), len(ids))
        score = np.einsum("ij,ij->i", self.q[rows[row]], v[col])
        if self.skip_same:
            score[self.qids[rows[row]] == ids[col]] = -np.inf
        if crowd.any():
            own = np.flatnonzero(crowd)
            scores = self.q[rows[own]] @ v.T
            self._mask(rows[own], scores, ids, match)
            r, c = _best_columns(scores, self.k, self.DIGITS)
            row, col, score = np.concatenate([row, own[r]]), np.concatenate([col, c]), np.concatenate([score, scores[r, c]])
        score = np.floor(score * self.DIGITS + 0.5) / self.DIGITS
        keep = (score >= floor[row]) & (score > -np.inf)
        return rows[row[keep]], score[keep], ids[col[keep]]

    def best(self):
        return self.top.all(self.qids)

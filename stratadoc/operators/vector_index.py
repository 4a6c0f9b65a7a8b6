"""Items filed by cells, so that an exact search leaves out cells that cannot matter.

Centres are a bounded sample of the items. Every item is filed under its nearest centre, and each cell knows
the largest angle of an item to its centre. By the triangle inequality on the sphere no item of a cell is
nearer to a question than the centre's angle less that radius. The sampled items give every question a floor,
the score of its k-th best among them, before any cell is read; cells below it are skipped, and a task only
emits what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratadoc.functions.vectors import present
from stratadoc.operators.kernels import _matrix, _unit
from stratadoc.session import durable

#: Cells, and sampled items, at most; they stand on the driver and travel with every task.
MOST_CELLS = 1_024
ITEMS_PER_CELL = 64
#: Slack of radii against rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``items`` with their ``_cell``, stored cell by cell; the sampled items and the radius of each cell."""

    items: DataFrame
    sample: pa.Table
    radius: np.ndarray

    def plain(self) -> dict:
        """What a task needs."""
        return {"sample": self.sample, "radius": self.radius}


def vector_index(items: DataFrame, *, item_id: str = "point_id", vector: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None) -> VectorIndex:
    """Index of items with a vector; ``keep`` names columns that searches filter or match on."""
    items = items.where(present(vector)).select(item_id, vector, *keep)
    if cells is None:
        cells = min(MOST_CELLS, max(1, items.count() // ITEMS_PER_CELL))
    sample = items.orderBy(F.xxhash64(item_id), item_id).limit(cells).toArrow().combine_chunks()
    types = dict(items.dtypes)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _unit(_matrix(sample.column(vector)))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unit = _unit(_matrix(batch.column(vector)))
            if unit.shape[1] != centres.shape[1]:
                raise ValueError("vectors of different dimension in one table")
            nearest = unit @ centres.T
            cell = nearest.argmax(axis=1)
            angle = np.arccos(np.clip(nearest[np.arange(len(cell)), cell], -1.0, 1.0))
            extra = [pa.array(cell.astype(np.int32)), pa.array(angle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_cell", "_angle"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in items.columns) + ", _cell int, _angle double"
    filed = items.mapInArrow(file, schema)
    # Ranges by cell and id, so that a cell with a third of all items spans several files.
    stored = durable(filed.repartitionByRange("_cell", F.xxhash64(item_id)).sortWithinPartitions("_cell"))
    radius = np.zeros(max(sample.num_rows, 1))
    for row in stored.groupBy("_cell").agg(F.max("_angle").alias("r")).collect():
        radius[row["_cell"]] = row["r"] + SLACK
    return VectorIndex(stored.drop("_angle"), sample, radius)

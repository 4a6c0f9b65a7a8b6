"""Counts of what passes through a job, taken while it runs and without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Counts:
    """Named aggregates observed on DataFrames as they are written.

    ``on`` returns the same rows with the aggregates attached; ``values`` gives what the first action over each
    of them has seen, and waits for it if it has not ended.
    """

    def __init__(self) -> None:
        self.observed: list[Observation] = []

    def on(self, rows: DataFrame, **aggregates: Column) -> DataFrame:
        observation = Observation()
        self.observed.append(observation)
        return rows.observe(observation, *[c.alias(name) for name, c in aggregates.items()])

    def values(self) -> dict[str, int]:
        return {name: value or 0 for o in self.observed for name, value in o.get.items()}


class BatchCounts(StreamingQueryListener):
    """Rows ``(name, batch_id, counts)`` of every batch of the streams that observe something.

        spark.streams.addListener(log := BatchCounts())
        stream.observe("arrived", F.count(F.lit(1)).alias("rows")).writeStream...
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.rows.append((name, event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

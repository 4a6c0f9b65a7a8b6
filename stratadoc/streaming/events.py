"""Event feed of answered questions: one status per finished step, then the answer or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratadoc import fixed_values as fv
from stratadoc.sources.writers import event_json


def step_events(steps: DataFrame) -> DataFrame:
    """Events of ``session_id, seq, node, content, failed`` rows.

    Adds ``part`` (0 status, 1 answer): the last step, ``responder``, also yields the answer. A failed
    step yields the error event only.
    """
    text = lambda v: F.lit(v).cast("string")

    def event(kind, node=None, content=None, session=True, info=None):
        return F.struct(
            text(kind).alias("type"),
            (text(None) if node is None else node).alias("node"),
            (text(None) if content is None else content).alias("content"),
            (F.col("session_id") if session else text(None)).alias("session_id"),
            (text(None) if info is None else info).alias("info"),
        )

    status = event("status", F.col("node"), info=F.concat(F.lit("Completed step: "), "node"))
    answer = event("answer", content=F.col("content"))
    error = event("error", content=F.lit(fv.INTERNAL_ERROR), session=False)
    events = (
        F.when(F.col("failed"), F.array(error))
        .when(F.col("node") == "responder", F.array(status, answer))
        .otherwise(F.array(status))
    )
    return steps.select("session_id", "seq", F.posexplode(events).alias("part", "event"))


def cached_events(hits: DataFrame) -> DataFrame:
    """The only event of a question answered from the cache."""
    return step_events(
        hits.select(
            "session_id", F.lit(0).alias("seq"), F.lit("responder").alias("node"),
            F.col("answer").alias("content"), F.lit(False).alias("failed"),
        )
    ).where(F.col("part") == 1)


def start_feed(steps: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the events of a stream of steps to a newline-delimited JSON folder."""
    lines = step_events(steps).select(event_json("event").alias("value"))
    return (
        lines.writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

"""Fixed-window rate limiting of a stream: window start and counter are the state of a client."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratadoc import fixed_values as fv


def rate_limit_stream(
    stream: DataFrame,
    *,
    key: str,
    ts: str,
    event_id: str,
    limit: int = fv.RATE_LIMIT,
    window_seconds: float = fv.RATE_WINDOW_SECONDS,
    forget_after: str | None = None,
) -> DataFrame:
    """``event_id, key, allowed``, by the same rule as the batch operator.

    Requests of a batch are put in order of (time, id); a request that arrives in a later batch with
    an earlier time is counted in the window then open, as a live counter would. How much of one client
    is in memory is bounded by the size of a batch, which the source's rate options set.

    A client's state is two numbers, kept for good unless ``forget_after`` names a delay: then state is
    dropped that long after its window ended, and requests arriving later than that are not decided.
    """
    window = int(window_seconds * 1_000_000)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}

    def count(who, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = rows["ts"].to_numpy()
        allowed = np.empty(len(rows), dtype=bool)
        at = 0
        while at < len(rows):
            if start is None or times[at] >= start + window:
                start, used = int(times[at]), 0
            end = max(at + 1, int(np.searchsorted(times, start + window)))
            allowed[at:end] = used + 1 + np.arange(end - at) <= limit
            used += end - at
            at = end
        state.update((start, used))
        if forget_after:
            state.setTimeoutTimestamp(max((start + window) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({event_id: rows["event_id"], key: who[0], "allowed": allowed})

    at = F.col(ts).cast("timestamp")
    rows = stream.select(
        F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.unix_micros(at).alias("ts"), at.alias("at")
    )
    rows = rows.withWatermark("at", forget_after) if forget_after else rows.drop("at")
    return rows.groupBy("key").applyInPandasWithState(
        count,
        f"{event_id} {types[event_id]}, {key} {types[key]}, allowed boolean",
        "start long, used long",
        "append",
        GroupStateTimeout.EventTimeTimeout if forget_after else GroupStateTimeout.NoTimeout,
    )

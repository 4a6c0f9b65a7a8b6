"""Fixed-window rate limiting of an event table, exact and without one task per client.

A window opens with a client's first request and covers ``[start, start + window)``; the next request
after it opens the next one. Which request opens a window thus depends on all earlier ones, so the
plain way is one ordered pass per client. Here time is cut into slices, and slices into spans:

1. requests shrink to distinct (client, time) ticks with counts, before the shuffle;
2. each (client, slice) works out alone where a window still open at its beginning leads to, as a short
   step function from the time the window ends to the end of the last window of the slice;
3. the functions of a span's slices are put one after the other to give the span's function;
4. per client these are followed from span to span, then within each span from slice to slice, which
   gives every slice its real beginning;
5. each (client, slice) marks its windows, again alone.

A slice's function has at most as many steps as the slice's first window has ticks, and chains that
meet stay together, so steps 3 and 4 see a small part of a busy client's ticks, in pieces; no step sees
a client's whole history. How long a slice is follows from the busiest client's measured requests. Groups of many
small clients share one call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stratadoc import fixed_values as fv
from stratadoc.session import durable

#: Windows of a slice at most, and requests that the busiest client's slice should hold.
SLICE_WINDOWS = 256
SLICE_ROWS = 20_000
SPAN_SLICES = 256
ROWS_PER_CALL = 50_000
_NEVER = -(2**62)
_ALWAYS = 2**62


def _runs(*columns: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal values, and the row after its last."""
    rows = len(columns[0])
    change = np.zeros(rows, dtype=bool)
    change[:1] = True
    for column in columns:
        values = column.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    begin = np.flatnonzero(change)
    return begin, np.r_[begin[1:], rows].astype(np.int64)


class _Slices:
    """Ticks of many slices, in order, with the tick that would open the window after each."""

    def __init__(self, pdf: pd.DataFrame, window: int, length: int) -> None:
        self.pdf = pdf = pdf.sort_values(["key", "slice", "ts"], ignore_index=True)
        self.ts = pdf["ts"].to_numpy()
        self.begin, self.end = _runs(pdf["key"], pdf["slice"])
        self.since = self.ts - pdf["slice"].to_numpy() * length
        self.next = np.empty(len(pdf), dtype=np.int64)
        # As many slices at a time as fit one axis of 62 bits end to end.
        room = length + window + 1
        step = max(1, 2**62 // room)
        for first in range(0, len(self.begin), step):
            begin, end = self.begin[first : first + step], self.end[first : first + step]
            rows = slice(begin[0], end[-1])
            group = np.repeat(np.arange(len(begin)), end - begin)
            axis = self.since[rows] + group * room
            after = np.searchsorted(axis, axis + window) + begin[0]
            self.next[rows] = np.where(after < end[group], after, len(pdf))

    def last_start(self) -> np.ndarray:
        """For each tick taken as a window start: the last start that its chain reaches in the slice."""
        rows = len(self.ts)
        jump, last = self.next.copy(), np.arange(rows)
        while (jump < rows).any():
            inside = jump < rows
            last[inside] = last[jump[inside]]
            jump[inside] = jump[jump[inside]]
        return last


def _transitions(window: int, length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slices = _Slices(pdf, window, length)
        leads_to = slices.ts[slices.last_start()] + window
        first = np.zeros(len(slices.ts), dtype=bool)
        first[slices.begin] = True
        # An open window ends less than one window into the slice.
        entry = first.copy()
        entry[1:] |= slices.since[:-1] < window
        out = slices.pdf[["key", "slice"]].assign(upto=slices.ts, leads_to=leads_to)[entry]
        begin, end = _runs(out["key"], out["slice"], out["leads_to"])
        return out.iloc[end - 1]

    return run


def _through(state: np.ndarray, upto: np.ndarray, leads_to: np.ndarray) -> np.ndarray:
    at = np.searchsorted(upto, state)
    return np.where(at < len(upto), leads_to[np.minimum(at, len(upto) - 1)], state)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Function of each span from those of its slices."""
    pdf = pdf.sort_values(["key", "span", "slice", "upto"], ignore_index=True)
    upto, leads_to = pdf["upto"].to_numpy(), pdf["leads_to"].to_numpy()
    begin, end = _runs(pdf["key"], pdf["span"], pdf["slice"])
    span_begin, span_end = _runs(pdf["key"], pdf["span"])
    parts = []
    at = np.searchsorted(begin, span_begin)
    for row, lo, hi in zip(span_begin, at, np.r_[at[1:], len(begin)]):
        one = slice(begin[lo], end[lo])
        # The last entry stands for a window that ends after all ticks of the first slice.
        state = np.r_[leads_to[one], _NEVER]
        for nth in range(lo + 1, hi):
            state = _through(state, upto[begin[nth] : end[nth]], leads_to[begin[nth] : end[nth]])
        ends = np.r_[upto[one], _ALWAYS]
        keep = np.r_[state[1:] != state[:-1], True]
        parts.append(
            pd.DataFrame(
                {"key": pdf["key"].iloc[row], "span": pdf["span"].iloc[row], "upto": ends[keep], "leads_to": state[keep]}
            )
        )
    return pd.concat(parts)


def _follow(pdf: pd.DataFrame, group: list[str], unit: str, start=None) -> pd.DataFrame:
    """``open_until`` of each unit (span or slice) of each group, from the group's ``start`` on."""
    pdf = pdf.sort_values([*group, unit, "upto"], ignore_index=True)
    upto, leads_to = pdf["upto"].to_numpy(), pdf["leads_to"].to_numpy()
    begin, end = _runs(*[pdf[c] for c in (*group, unit)])
    fresh = np.isin(begin, _runs(*[pdf[c] for c in group])[0])
    given = pdf["open_until"].to_numpy() if start else None
    open_until, entries = _NEVER, []
    for lo, hi, new in zip(begin, end, fresh):
        if new:
            open_until = int(given[lo]) if start else _NEVER
        entries.append(open_until)
        at = lo + int(np.searchsorted(upto[lo:hi], open_until))
        if at < hi:
            open_until = int(leads_to[at])
    return pdf.iloc[begin][["key", unit]].assign(open_until=entries)


def _follow_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    return _follow(pdf, ["key"], "span")


def _follow_slices(steps: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    pdf = steps.merge(spans[["key", "span", "open_until"]], on=["key", "span"])
    return _follow(pdf, ["key", "span"], "slice", start=True)


def _mark(window: int, length: int):
    def run(ticks: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        pdf = ticks.merge(entries[["key", "slice", "open_until"]], on=["key", "slice"])
        slices = _Slices(pdf, window, length)
        rows = len(slices.ts)
        open_until = slices.pdf["open_until"].to_numpy()
        opens = np.zeros(rows, dtype=bool)
        # First tick of each slice that no earlier window covers, then all slices step by step.
        free = slices.ts >= open_until
        at = np.array([lo + int(np.argmax(free[lo:hi])) if free[hi - 1] else rows for lo, hi in zip(slices.begin, slices.end)])
        while len(at := at[at < rows]):
            opens[at] = True
            at = slices.next[at]
        last = np.maximum.accumulate(np.where(opens, np.arange(rows), -1))
        own = last >= np.repeat(slices.begin, slices.end - slices.begin)
        start = np.where(own, slices.ts[np.maximum(last, 0)], open_until - window)
        return slices.pdf[["key", "ts", "n"]].assign(window_start=start)

    return run


def measured_slice(events: DataFrame, key: str, ts: str, window_seconds: float) -> int:
    """Windows per slice, so that a slice of the busiest client holds about ``SLICE_ROWS`` requests.

    Counts are taken per client and window-long bin and added up in every task first. A slice is at least one
    window long, so a client with more requests than that in one window has them in one slice.
    """
    bins = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / int(window_seconds * 1_000_000))
    busiest = events.groupBy(key, bins.alias("_bin")).count().agg(F.max("count")).first()[0] or 1
    return max(1, min(SLICE_WINDOWS, SLICE_ROWS // busiest))


def windows(
    events: DataFrame,
    key: str,
    ts: str,
    window_seconds: float,
    slice_windows: int | None = None,
    span_slices: int = SPAN_SLICES,
) -> DataFrame:
    """``key, ts, n, window_start`` (times in microseconds) per distinct (client, time)."""
    window = int(window_seconds * 1_000_000)
    events = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    length = window * (slice_windows or measured_slice(events, key, ts, window_seconds))
    cores = events.sparkSession.sparkContext.defaultParallelism
    calls = max(cores, -(-events.count() // ROWS_PER_CALL))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    kind = events.schema[key].dataType.simpleString()

    def call(*columns):
        return F.pmod(F.xxhash64(*columns), F.lit(calls)).alias("_call")

    ticks = (
        events.select(F.col(key).alias("key"), micros.alias("ts"))
        .groupBy("key", "ts")
        .agg(F.count("*").alias("n"))
        .withColumn("slice", F.floor(F.col("ts") / length).cast("long"))
    )
    by_slice = ticks.select("*", call("key", "slice")).groupBy("_call")
    steps = by_slice.applyInPandas(
        _transitions(window, length), f"key {kind}, slice long, upto long, leads_to long"
    ).withColumn("span", F.floor(F.col("slice") / span_slices).cast("long"))
    by_span = steps.select("*", call("key", "span")).groupBy("_call")
    spans = by_span.applyInPandas(_compose, f"key {kind}, span long, upto long, leads_to long")
    beginnings = (
        spans.select("*", call("key"))
        .groupBy("_call")
        .applyInPandas(_follow_spans, f"key {kind}, span long, open_until long")
        .select("*", call("key", "span"))
        .groupBy("_call")
    )
    entries = by_span.cogroup(beginnings).applyInPandas(
        _follow_slices, f"key {kind}, slice long, open_until long"
    )
    entries = entries.select("*", call("key", "slice")).groupBy("_call")
    return by_slice.cogroup(entries).applyInPandas(
        _mark(window, length), f"key {kind}, ts long, n long, window_start long"
    )


def window_counts(marked: DataFrame) -> DataFrame:
    """Requests per client and window, rejected ones included."""
    return marked.groupBy("key", "window_start").agg(F.sum("n").alias("requests"))


def rate_limit(
    events: DataFrame,
    *,
    key: str,
    ts: str,
    event_id: str,
    limit: int = fv.RATE_LIMIT,
    window_seconds: float = fv.RATE_WINDOW_SECONDS,
    slice_windows: int | None = None,
    span_slices: int = SPAN_SLICES,
) -> DataFrame:
    """``event_id, key, allowed``: the first ``limit`` requests of each window pass, by (time, id).

    A request without client or time cannot be counted; it is returned with ``allowed`` null.
    """
    marked = windows(events, key, ts, window_seconds, slice_windows, span_slices)
    # Every tick is a request at least, so only the first ``limit`` ticks of a window can let one pass.
    # The rank filter cuts a busy window in every task before it meets in one; the sum runs over the rest.
    in_window = Window.partitionBy("key", "window_start").orderBy("ts")
    first = marked.withColumn("_nth", F.row_number().over(in_window)).where(F.col("_nth") <= limit)
    earlier = in_window.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(limit) - F.coalesce(F.sum("n").over(earlier), F.lit(0))
    open_ticks = first.select("key", "ts", "n", left.alias("_left")).where("_left > 0")
    ticks = durable(open_ticks.select("key", "ts", "_left", (F.col("n") > F.col("_left")).alias("_split")))
    every = events.select(
        F.col(event_id).alias("event_id"),
        F.col(key).alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"),
    )
    requests = every.where("key is not null and ts is not null")
    unknown = every.where("key is null or ts is null").select(
        "event_id", "key", F.lit(None).cast("boolean").alias("allowed")
    )
    met = requests.join(ticks, ["key", "ts"], "left")
    plain = met.where(~F.coalesce("_split", F.lit(False))).select(
        "event_id", "key", F.col("_left").isNotNull().alias("allowed")
    )
    # Simultaneous requests of which only some pass: rank them by id, cut in every task to the limit.
    shared = requests.join(ticks.where("_split"), ["key", "ts"])
    by_id = Window.partitionBy("key", "ts").orderBy("event_id")
    passed = (
        shared.withColumn("_n", F.row_number().over(by_id))
        .where(F.col("_n") <= limit)
        .where(F.col("_n") <= F.col("_left"))
        .select("event_id", F.lit(True).alias("_pass"))
    )
    mixed = shared.join(passed, "event_id", "left").select(
        "event_id", "key", F.coalesce("_pass", F.lit(False)).alias("allowed")
    )
    return plain.unionByName(mixed).unionByName(unknown).select(
        F.col("event_id").alias(event_id), F.col("key").alias(key), "allowed"
    )

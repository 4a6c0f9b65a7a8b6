"""Rate limiting against a plain pass over each client's requests."""

import random

import pytest
from pyspark.sql import functions as F

from stratadoc.operators.rate_limit import rate_limit, window_counts, windows

WINDOW = 60


def model(rows, limit):
    """Decision per request id, and the number of requests per (client, window start)."""
    allowed, counts, state = {}, {}, {}
    for event, key, micros in sorted(rows, key=lambda r: (r[2], r[0])):
        start, used = state.get(key, (None, 0))
        if start is None or micros >= start + WINDOW * 1_000_000:
            start, used = micros, 0
        used += 1
        state[key] = (start, used)
        counts[(key, start)] = used
        allowed[event] = used <= limit
    return allowed, counts


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, client string, micros long")
    return df.select("event_id", "client", F.timestamp_micros("micros").alias("ts"))


def traffic(seed, seconds, n, clients, hot):
    rng = random.Random(seed)
    rows = []
    for event in range(n):
        client = "hot" if rng.random() < hot else f"c{rng.randrange(clients)}"
        # Coarse times give many simultaneous requests and exact window ends.
        rows.append((event, client, 1_700_000_000_000_000 + rng.randrange(seconds * 4) * 250_000))
    return rows


@pytest.mark.parametrize("slice_windows,span_slices,limit", [(256, 256, 3), (1, 1, 1), (1, 3, 3), (5, 4, 2)])
def test_matches_plain_pass(spark, slice_windows, span_slices, limit):
    rows = traffic(slice_windows, 3_000, 2_500, 12, 1 / 3)
    expected, counts = model(rows, limit)
    df = frame(spark, rows)
    sizes = {"slice_windows": slice_windows, "span_slices": span_slices}
    got = rate_limit(df, key="client", ts="ts", event_id="event_id", limit=limit, window_seconds=WINDOW, **sizes)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == expected
    marked = windows(df, "client", "ts", WINDOW, **sizes)
    assert {(r["key"], r["window_start"]): r["requests"] for r in window_counts(marked).collect()} == counts


def test_request_at_window_end_opens_the_next(spark):
    base = 1_700_000_000_000_000
    rows = [(0, "a", base), (1, "a", base + 59_999_999), (2, "a", base + 60_000_000), (3, "b", base + 1)]
    got = rate_limit(frame(spark, rows), key="client", ts="ts", event_id="event_id", limit=1, window_seconds=WINDOW)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == {0: True, 1: False, 2: True, 3: True}


def test_sparse_client_over_many_spans(spark):
    base = 1_700_000_000_000_000
    rows = [(i, "a", base + i * 7_919_000_000) for i in range(200)] + [
        (1000 + i, "a", base + i * 7_919_000_000 + 30_000_000) for i in range(200)
    ]
    expected, _ = model(rows, 1)
    got = rate_limit(
        frame(spark, rows), key="client", ts="ts", event_id="event_id", limit=1, window_seconds=WINDOW,
        slice_windows=2, span_slices=8,
    )
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == expected


def test_requests_without_client_or_time_are_returned(spark):
    rows = [(1, "a", 0), (2, None, 5), (3, "a", None), (4, None, None)]
    out = rate_limit(frame(spark, rows), key="client", ts="ts", event_id="event_id", limit=1, window_seconds=WINDOW)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", True), (2, None, None), (3, "a", None), (4, None, None)]

"""State of questions kept by a stream: messages add up, other fields keep the last value set."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stratadoc.sources.keyed_log import append_batch, newest

FIELDS = ("documents", "current_query", "plan", "tool_choice", "tool_input")
MESSAGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StateReducer(StatefulProcessor):
    """Messages in a list state, every other field with the step that set it in a value state.

    Steps may arrive in any order over any number of batches: messages come out by ``seq``, and a field is
    overwritten by later steps only. State not touched for ``forget_after_ms`` is dropped by the store.
    """

    def __init__(self, key: str, fields: dict[str, T.DataType], forget_after_ms: int | None):
        self.key, self.fields, self.ttl = key, fields, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", MESSAGE, ttlDurationMs=self.ttl)
        self.values = {}
        for name, kind in self.fields.items():
            schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", kind)])
            self.values[name] = handle.getValueState(name, schema, ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added, latest = [], {}
        for frame in rows:
            for row in frame.to_dict("records"):
                step = int(row["seq"])
                if row["messages"] is not None:
                    added += [(step, m["role"], m["content"]) for m in row["messages"]]
                for name in self.fields:
                    value = row[name].tolist() if hasattr(row[name], "tolist") else row[name]
                    if value is not None and (name not in latest or latest[name][0] < step):
                        latest[name] = (step, value)
        if added:
            self.messages.appendList(added)
        out = {self.key: key[0]}
        kept = sorted(self.messages.get(), key=lambda m: m[0]) if self.messages.exists() else []
        out["messages"] = [{"role": m[1], "content": m[2]} for m in kept]
        for name, state in self.values.items():
            stored = state.get() if state.exists() else None
            if name in latest and (stored is None or stored[0] <= latest[name][0]):
                stored = latest[name]
                state.update(stored)
            out[name] = stored[1] if stored else None
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Stateful processors need the store with several states per key; other streams keep theirs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def reduced(steps: DataFrame, key: str, seq: str = "seq", forget_after_ms: int | None = None) -> DataFrame:
    """The state of every key that a batch of the stream touches, as :func:`conversation.reduce_states` gives it.

    ``steps`` has ``key, seq, messages`` and any of the other fields; messages of one step stay in order.
    """
    fields = {c: steps.schema[c].dataType for c in FIELDS if c in steps.columns}
    out = T.StructType([T.StructField(key, steps.schema[key].dataType)])
    out = out.add("messages", T.ArrayType(T.StructType(MESSAGE.fields[1:])))
    for name, kind in fields.items():
        out = out.add(name, kind)
    rows = steps.select(key, F.col(seq).cast("long").alias("seq"), "messages", *fields)
    return rows.groupBy(key).transformWithStateInPandas(
        StateReducer(key, fields, forget_after_ms), out, "Update", "ProcessingTime" if forget_after_ms else "None"
    )


def start_states(steps: DataFrame, root: str, checkpoint: str, key: str, **options) -> StreamingQuery:
    """Store the states that each batch changes under ``root``; the newest of a key is its state now."""
    with _rocks(steps.sparkSession):
        return (
            reduced(steps, key, **options)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda rows, batch_id: append_batch(rows, root, batch_id))
            .trigger(availableNow=True)
            .start()
        )


def current_states(spark: SparkSession, root: str, key: str) -> DataFrame:
    return newest(spark.read.parquet(root), key)

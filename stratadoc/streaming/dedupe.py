"""Content that arrives again is dropped, as long as the watermark remembers it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stratadoc.functions.text import content_id


def drop_repeats(stream: DataFrame, content: str, event_time: str, delay: str = "1 day") -> DataFrame:
    return (
        stream.withColumn("content_id", content_id(content))
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["content_id"])
    )

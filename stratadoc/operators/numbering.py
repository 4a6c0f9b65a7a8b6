"""Consecutive numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stratadoc.session import durable


def dense_index(
    df: DataFrame,
    order: list[str],
    name: str,
    first: int = 1,
    ranges: int | None = None,
) -> DataFrame:
    """Number rows ``first, first + 1, ...`` by ``order``, whose columns together must be unique.

    The rows are sorted in as many ranges as the session shuffles into, or ``ranges``, and stored with their
    range and place. Each range then adds the count of all earlier ranges; one narrow row per range meets in
    one task. A hot leading value is cut by the later columns.
    """
    ranged = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = durable(ranged.sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_n": place}))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_n") + F.lit(first))
    return numbered.drop("_range", "_n", "_before")

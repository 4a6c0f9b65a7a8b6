"""Keyed tables on plain files: upserts append a batch, readers take the newest row per key.

A batch is one ``batch_id=N`` folder. Writing a batch again replaces that folder only, so a replayed
stream batch changes nothing and no folder is rewritten while others read it. ``compact`` folds
everything into a new root when the number of batches calls for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def read_batches(spark: SparkSession, root: str, like: DataFrame, before: int | None = None) -> DataFrame:
    """All batches with their ``batch_id``; an empty frame of the same columns if there are none."""
    schema = like.schema.add("batch_id", "long")
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(root)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Newest row per key. Only keys and batch numbers are aggregated, not the rows themselves."""
    last = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [key, "batch_id"], "left_semi").drop("batch_id")


def compact(spark: SparkSession, root: str, new_root: str, key: str, like: DataFrame) -> None:
    append_batch(newest(read_batches(spark, root, like), key), new_root, 0)

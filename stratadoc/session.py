"""Session settings every job relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import stratadoc

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits hot join keys at run time, even where the split costs a further shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Files named one by one are listed by so many tasks, not by one task a file.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of texts, vectors or files in a Python worker, whichever is reached first.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built.

    Python functions travel to the executors by value, so the package need not be installed there.
    """
    cloudpickle.register_pickle_by_value(stratadoc)
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use spark-submit and :func:`configure`."""
    builder = (
        SparkSession.builder.master(master)
        .appName("stratadoc")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session within one process may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="stratadoc-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back.

    Later stages read files, so a lost executor recomputes nothing upstream, each row is worked out
    once, and Spark knows the true size when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratadoc/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

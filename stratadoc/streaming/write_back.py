"""What an answered question leaves behind: both turns in the history, and a cache entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratadoc.functions.vectors import as_double
from stratadoc.operators.embedding import hashed_vector
from stratadoc.sources.keyed_log import append_batch
from stratadoc.sources.writers import cache_entries


def history_turns(answered: DataFrame) -> DataFrame:
    """User and assistant turn of every question with a non-empty answer, cached or new."""
    turn = lambda role, content, n: F.struct(
        F.lit(n).alias("part"), F.lit(role).alias("role"), F.col(content).alias("content")
    )
    return (
        answered.where(F.coalesce("answer", F.lit("")) != "")
        .select("question_id", "session_id", "user_id",
                F.explode(F.array(turn("user", "question", 0), turn("assistant", "answer", 1))).alias("t"))
        .select("question_id", "session_id", "user_id", "t.part", "t.role", "t.content")
    )


def new_cache_rows(answered: DataFrame, embed=hashed_vector, order: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Entries of questions that were not answered from the cache; the last answer by ``order`` wins."""
    fresh = answered.where(~F.col("hit") & (F.coalesce("answer", F.lit("")) != ""))
    last = fresh.groupBy("question").agg(F.max_by("answer", F.struct(*order)).alias("answer"))
    return cache_entries(last, lambda q: as_double(embed(q)), "question", "answer")


def write_back_batch(answered: DataFrame, batch_id: int, root: str) -> None:
    append_batch(history_turns(answered), f"{root}/history", batch_id)
    append_batch(new_cache_rows(answered), f"{root}/cache", batch_id)


def start_write_back(answered: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    return (
        answered.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, batch_id: write_back_batch(df, batch_id, root))
        .trigger(availableNow=True)
        .start()
    )

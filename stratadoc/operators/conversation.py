"""Conversation tables: history window, appended turns, messages of a question, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stratadoc import fixed_values as fv
from stratadoc.operators.numbering import dense_index


def valid_requests(df: DataFrame, message: str = "message", session: str = "session_id") -> DataFrame:
    """Non-empty messages; a missing session gets a new id."""
    return df.where(F.length(message) >= 1).withColumn(session, F.coalesce(F.col(session), F.uuid()))


def last_turns(history: DataFrame, session: str, order: list[str], n: int = fv.HISTORY_LIMIT) -> DataFrame:
    """Newest ``n`` rows of each session.

    The rank filter is applied within every map task first, so a session with a third of all turns
    sends ``n`` rows per task.
    """
    newest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def message_lists(turns: DataFrame, session: str, order: list[str], role: str = "role", content: str = "content") -> DataFrame:
    """``messages`` per session, oldest first; give it rows already cut by :func:`last_turns`."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(F.col(role).alias("role"), F.col(content).alias("content")).alias("m"))))
    return turns.groupBy(session).agg(F.transform(packed, lambda t: t["m"]).alias("messages"))


def chat_messages(
    requests: DataFrame,
    history: DataFrame,
    order: list[str],
    *,
    session: str = "session_id",
    message: str = "message",
    n: int = fv.CHAT_HISTORY_LIMIT,
) -> DataFrame:
    """Each request with its last ``n`` turns and itself as the newest user message."""
    asked = history.join(requests.select(session), session, "left_semi")
    past = message_lists(last_turns(asked, session, order, n), session, order)
    none = F.array().cast("array<struct<role:string,content:string>>")
    now = F.array(F.struct(F.lit("user").alias("role"), F.col(message).alias("content")))
    return (
        requests.join(past, session, "left")
        .withColumn("history", F.coalesce("messages", none))
        .withColumn("messages", F.concat("history", now))
    )


def stamped_turns(df: DataFrame) -> DataFrame:
    """Turns to be stored, with the defaults for metadata and time."""
    empty = F.create_map().cast("map<string,string>")
    return df.withColumn("metadata_", empty).withColumn("created_at", F.current_timestamp())


def append_history(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Existing rows and new ones, whose ids go on after the largest id."""
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    numbered = dense_index(new, order, "id", first=start + 1)
    return existing.unionByName(numbered.select(*existing.columns))


def valid_feedback(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isin(1, -1)).select("session_id", "user_id", "message_id", "score", "comment")


def reduce_states(steps: DataFrame, question_id: str = "question_id", seq: str = "seq") -> DataFrame:
    """State of each question after its steps: messages appended, other fields overwritten if set.

    A question has a handful of steps, so its list is small by nature.
    """
    none = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct(seq, F.coalesce("messages", none).alias("m")))),
            lambda s: s["m"],
        )
    )
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
        for c in ("documents", "current_query", "plan", "tool_choice", "tool_input")
        if c in steps.columns
    ]
    return steps.groupBy(question_id).agg(messages.alias("messages"), *last)

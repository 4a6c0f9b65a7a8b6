"""Plan records: parsing with defaults, routing, tool dispatch, the source of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.text import col, strip


def normalise_plans(df: DataFrame, plan: str = "plan", question: str = "question") -> DataFrame:
    """Add ``current_query, plan_steps, tool_choice, tool_input`` from the plan's JSON text.

    Anything but one JSON object with an ``action`` key and textual tool fields gives the fallback.
    """
    # Inside brackets, text after the object makes the JSON invalid instead of being ignored.
    listed = F.concat(F.lit("["), col(plan), F.lit("]"))
    value = F.try_parse_json(listed)
    keys = F.json_object_keys(col(plan))

    def field(name: str) -> Column:
        return F.try_variant_get(value, f"$[0].{name}", "string")

    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    def is_text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$[0].{name}", "variant"))
        empty = field(name).isin("0", "false", "[]", "{}", "0.0")
        return F.coalesce(kind.isin("STRING", "VOID") | empty, F.lit(True))

    def tool_text(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$[0].{name}", "variant"))
        return F.when(kind == "STRING", strip(field(name))).otherwise(F.lit(""))

    valid = F.coalesce(
        value.isNotNull()
        & (F.json_array_length(listed) == 1)
        & has("action")
        & is_text("tool_choice")
        & is_text("tool_input"),
        F.lit(False),
    )
    refined = F.when(has("refined_query"), field("refined_query")).otherwise(col(question))
    use_tool = F.coalesce(field("action") == "tool_use", F.lit(False))
    given = tool_text("tool_input")
    reason = F.when(has("reasoning"), field("reasoning")).otherwise(F.lit(fv.PLAN_DONE))
    return df.withColumns(
        {
            "current_query": F.when(valid, refined).otherwise(col(question)),
            "plan_steps": F.array(F.when(valid, reason).otherwise(F.lit(fv.PLAN_FAILED))),
            "tool_choice": F.when(valid & use_tool, tool_text("tool_choice")).otherwise(F.lit("")),
            "tool_input": F.when(
                valid & use_tool, F.when(given != "", given).otherwise(refined)
            ).otherwise(F.lit("")),
        }
    )


def route(tool_choice="tool_choice", action=None) -> Column:
    """``tool`` if a tool is named, else ``retriever``; with an action column, direct answers skip both."""
    picked = strip(F.coalesce(col(tool_choice), F.lit(""))) != ""
    out = F.when(picked, F.lit("tool"))
    if action is not None:
        out = out.when(col(action) == "direct_answer", F.lit("responder"))
    return out.otherwise(F.lit("retriever"))


def dispatch(df: DataFrame, steps: str = "plan_steps") -> DataFrame:
    """Add ``tool_name, tool_text, branch``; ``branch`` is a tool, ``none`` or ``unknown``."""
    name = F.coalesce("tool_choice", F.lit("calculator"))
    given = F.coalesce("tool_input", F.lit(""))
    return df.withColumns(
        {
            "tool_name": name,
            "tool_text": F.when(given != "", given).otherwise(F.col("current_query")),
            "branch": F.when(F.coalesce(F.size(steps), F.lit(0)) <= 0, F.lit("none"))
            .when(name.isin(*fv.TOOL_NAMES), name)
            .otherwise(F.lit("unknown")),
        }
    )


def run_tools(dispatched: DataFrame, tools: dict, question_id: str = "question_id") -> DataFrame:
    """``question_id, role, content``: the message each dispatched row produces.

    ``tools`` maps a branch to a function from ``(question_id, tool_text)`` rows to
    ``(question_id, result)`` rows; every tool runs once over all its rows. A branch without an entry
    gives the message for unknown tools.
    """
    none = dispatched.where(F.col("branch") == "none").select(
        question_id, F.lit("system").alias("role"), F.lit(fv.NO_TOOL).alias("content")
    )
    unserved = ~F.col("branch").isin("none", *tools)
    results = [
        dispatched.where(unserved).select(question_id, F.lit(fv.UNKNOWN_TOOL).alias("result"))
    ]
    for branch, tool in tools.items():
        rows = dispatched.where(F.col("branch") == branch).select(question_id, "tool_text")
        results.append(tool(rows).select(question_id, "result"))
    out = none
    for result in results:
        out = out.unionByName(
            result.select(
                question_id,
                F.lit("user").alias("role"),
                F.concat(F.lit(fv.TOOL_PREFIX + " "), "result").alias("content"),
            )
        )
    return out


def last_tool_output(messages="messages") -> Column:
    """Text of the newest message that starts with the tool prefix, else an empty string."""
    outputs = F.filter(col(messages), lambda m: m["content"].startswith(fv.TOOL_PREFIX))
    text = F.try_element_at(outputs, F.lit(-1))["content"]
    return F.coalesce(strip(F.substring(text, len(fv.TOOL_PREFIX) + 1, 2**31 - 1)), F.lit(""))


def answer_source(df: DataFrame) -> DataFrame:
    """Add ``tool_output, source_label, source_content`` to rows with messages and documents."""
    chosen = F.coalesce("tool_choice", F.lit("")) != ""
    output = F.when(chosen, last_tool_output()).otherwise(F.lit(""))
    context = F.coalesce(F.array_join("documents", "\n\n"), F.lit(""))
    return df.withColumn("tool_output", output).withColumns(
        {
            "source_label": F.when(F.col("tool_output") != "", F.lit(fv.LABEL_TOOL)).otherwise(
                F.lit(fv.LABEL_CONTEXT)
            ),
            "source_content": F.when(F.col("tool_output") != "", F.col("tool_output")).otherwise(context),
        }
    )

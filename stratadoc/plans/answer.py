"""From raw pages and a table of questions to contexts and prompts, as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.html import clean_text
from stratadoc.operators.chunking import chunk, enrich, recursive_chunks
from stratadoc.operators.embedding import embed_hashed
from stratadoc.operators.fulltext import NameIndex, name_index
from stratadoc.operators.graph import expand_directed, expand_undirected, graph_tool_text
from stratadoc.operators.planning import answer_source, dispatch, normalise_plans, route, run_tools
from stratadoc.operators.prompts import answer_prompt
from stratadoc.operators.retrieval import (
    documents_per_question,
    graph_contexts,
    hybrid_contexts,
    vector_contexts,
)
from stratadoc.operators.vector_index import VectorIndex
from stratadoc.operators.vector_search import cache_lookup, search_tool_text, vector_topk
from stratadoc.session import durable
from stratadoc.sources.writers import POINT_KEY, vector_points


def index_pages(pages: DataFrame, split: Callable = recursive_chunks) -> DataFrame:
    """Vector points of pages ``(filename, html)``: clean text, chunks, metadata, vectors."""
    texts = pages.select("filename", clean_text("html").alias("text"))
    chunks = enrich(chunk(texts, split("text")), clock=False)
    # Copies of a chunk of one file are one point; they go before the costly step.
    return vector_points(embed_hashed(chunks.dropDuplicates(list(POINT_KEY))))


def page_contexts(questions: DataFrame, points: DataFrame, k: int = fv.SEARCH_LIMIT, index: VectorIndex | None = None) -> DataFrame:
    """``question_id, rank, score, text``: cited chunks for questions ``(question_id, text)``."""
    hits = vector_topk(embed_hashed(questions.select("question_id", "text")), index or points, k=k)
    cited = points.select(
        "point_id", F.concat("text", F.lit(" [Source: "), "filename", F.lit("]")).alias("text")
    )
    return hits.join(cited, "point_id").select("question_id", "rank", "score", "text")


def search_tools(
    points: DataFrame, nodes: DataFrame, edges: DataFrame, entities: Callable, index: NameIndex | None = None
) -> dict[str, Callable]:
    """The search tools by name: functions from ``(question_id, tool_text)`` to ``(question_id, result)``.

    ``entities`` gives ``question_id, pos, entity`` for such rows, as a model or a rule finds them.
    """

    def vector_search(rows: DataFrame) -> DataFrame:
        asked = rows.select("question_id", F.col("tool_text").alias("text"))
        hits = vector_topk(embed_hashed(asked), points, k=fv.TOOL_SEARCH_LIMIT)
        return search_tool_text(asked, hits, points, question_id="question_id", item_id="point_id")

    def graph_search(rows: DataFrame) -> DataFrame:
        named = durable(entities(rows))
        found = expand_undirected(named.where("entity is not null"), nodes, edges, index=index)
        return graph_tool_text(rows, named, found)

    return {"vector_search": vector_search, "graph_search": graph_search}


def whole_text(rows: DataFrame) -> DataFrame:
    """The tool's text taken as one entity; the graph's full-text lookup picks the names in it."""
    return rows.select("question_id", F.lit(0).alias("pos"), F.col("tool_text").alias("entity"))


def answer_prompts(
    questions: DataFrame,
    points: DataFrame,
    cache: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    entities: Callable = whole_text,
    dead_letters: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Prompts of questions ``(question_id, question, plan)`` that the cache cannot answer.

    Cache lookup, plan normalisation and routing give a state table. Rows whose plan names a tool get
    the tool's output as a message, the others the contexts of the hybrid retrieval; the prompt builds
    on either. A graph branch that fails gives no contexts and a row for ``dead_letters``.
    """
    embedded = embed_hashed(questions.select("question_id", F.col("question").alias("text")))
    hits = cache_lookup(embedded, cache)
    missed = questions.join(hits.where("hit").select("question_id"), "question_id", "left_anti")
    # The state table of this batch of questions: both branches and the prompt read it.
    planned = durable(normalise_plans(missed).withColumn("route", route()))
    asked = planned.where(F.col("route") == "retriever").select(
        "question_id", F.coalesce("current_query", F.lit("")).alias("text")
    )
    # Both the branch and the tool look names up in it.
    index = name_index(nodes)

    def passages() -> DataFrame:
        found = vector_topk(embed_hashed(asked), points)
        return vector_contexts(found, points, question_id="question_id", item_id="point_id")

    def facts() -> DataFrame:
        return graph_contexts(expand_directed(asked, nodes, edges, index=index), question_id="question_id")

    contexts, letters = hybrid_contexts(passages, facts, question_id="question_id")
    if dead_letters is not None:
        dead_letters(letters)
    dispatched = dispatch(planned.where(F.col("route") == "tool"))
    outputs = run_tools(dispatched, search_tools(points, nodes, edges, entities, index))
    messages = outputs.select("question_id", F.array(F.struct("role", "content")).alias("messages"))
    state = documents_per_question(planned, contexts, question_id="question_id").join(messages, "question_id", "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    state = state.withColumn("messages", F.coalesce("messages", none))
    return answer_source(state).select(
        "question_id", "route", "current_query", "documents", answer_prompt().alias("prompt")
    )

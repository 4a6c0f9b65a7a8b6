"""Vector retrieval: top-k search, the search tool's text, and the semantic answer cache."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from stratadoc import fixed_values as fv
from stratadoc.functions.text import cited_excerpt
from stratadoc.functions.vectors import present
from stratadoc.operators.kernels import CosineKernel
from stratadoc.operators.ranked_scan import BROADCAST_BYTES, scan_topk
from stratadoc.operators.vector_index import VectorIndex
from stratadoc.session import durable


def drop_missing_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.where(present(vector))


def above_threshold(hits: DataFrame, threshold: float = fv.CACHE_THRESHOLD) -> DataFrame:
    """Inclusive lower bound on the score."""
    return hits.where(F.col("score") >= threshold)


def vector_topk(
    questions: DataFrame,
    items: DataFrame | VectorIndex,
    *,
    question_id: str = "question_id",
    item_id: str = "point_id",
    vector: str = "embedding",
    k: int = fv.SEARCH_LIMIT,
    threshold: float | None = None,
    filters: dict | None = None,
    match_on: str | None = None,
    skip_same: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    **blocks: int,
) -> DataFrame:
    """Exact cosine top-k: ``(question_id, item_id, score, rank)``.

    ``filters`` (column to value) and ``match_on`` (a column of both sides; null in a question means
    no restriction) apply before the top-k. Only ids and vectors enter the scan; join the payload to
    the few hits afterwards. Items given as an index are scanned cell by cell, without cells that cannot hold a hit.
    """
    cells = None
    if isinstance(items, VectorIndex):
        # Floors come from the sampled items, all of which a filter would have to let pass.
        cells, items = None if filters else items.plain(), items.items
    for name, value in (filters or {}).items():
        items = items.where(F.col(name) == F.lit(value))
    extra = [match_on] if match_on else []
    # Written, since it is measured and then collected or cut into blocks.
    questions = durable(drop_missing_vectors(questions, vector).select(question_id, vector, *extra))
    # Items without a vector are left out by the kernel.
    items = items.select(item_id, vector, *extra, *(["_cell"] if cells else []))
    text_bytes = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in (question_id, *extra)), F.lit(0))
    size = questions.agg(
        F.count("*").alias("rows"), F.sum(F.size(vector).cast("long") * 8 + 32 + text_bytes).alias("bytes")
    ).first()
    kernel = partial(
        CosineKernel,
        question_id=question_id,
        item_id=item_id,
        vector=vector,
        k=k,
        threshold=threshold,
        skip_same=skip_same,
        match_on=match_on,
        cells=cells,
    )
    return scan_topk(
        questions,
        items,
        kernel,
        question_id=question_id,
        item_id=item_id,
        k=k,
        question_rows=size["rows"],
        question_bytes=size["bytes"] or 0,
        broadcast_bytes=broadcast_bytes,
        **blocks,
    )


def search_tool_text(
    questions: DataFrame, hits: DataFrame, payload: DataFrame, *, question_id: str, item_id: str
) -> DataFrame:
    """One text per question: its ranked hits with excerpt, file and page, or a fixed message.

    ``payload`` has ``item_id, text, filename, page``; only the excerpt travels through the join.
    """
    lines = payload.select(item_id, cited_excerpt("text", "filename", "page").alias("line"))
    # At most k short lines per question are collected.
    text = (
        hits.join(lines, item_id)
        .groupBy(question_id)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
        .select(question_id, F.array_join("lines.line", "").alias("result"))
    )
    return (
        questions.select(question_id)
        .join(text, question_id, "left")
        .select(question_id, F.coalesce("result", F.lit(fv.NO_DOCUMENTS)).alias("result"))
    )


def cache_lookup(
    questions: DataFrame,
    cache: DataFrame,
    *,
    question_id: str = "question_id",
    threshold: float = fv.CACHE_THRESHOLD,
    scope: str | None = None,
    **scan,
) -> DataFrame:
    """Every question with its nearest cached answer, null columns where none is near enough.

    The cache is shared by all users; ``scope`` names a column both sides must agree on.
    """
    hits = vector_topk(
        questions,
        cache,
        question_id=question_id,
        item_id="entry_id",
        k=1,
        threshold=threshold,
        match_on=scope,
        **scan,
    ).select(question_id, "entry_id", "score")
    answers = hits.join(cache.select("entry_id", "answer"), "entry_id")
    return questions.select(question_id).join(answers, question_id, "left").select(
        question_id, F.col("entry_id").isNotNull().alias("hit"), "entry_id", "answer", "score"
    )

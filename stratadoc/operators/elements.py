"""Documents put together from an elements table ``(doc_id, seq, category, text[, cells])``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.functions.text import strip

BLOCK = 256


def _joined(df: DataFrame, doc: str, order: tuple[str, ...], piece: Column, separator: str, *extra) -> DataFrame:
    """Ordered concatenation in two steps, so that one long document is put together by many tasks.

    ``order`` starts with a coarse column and ends with the sequence number; blocks of consecutive
    sequence numbers become one string each, and only those strings meet in the document's row.
    """
    *coarse, seq = order
    block = F.floor(F.col(seq) / BLOCK)
    parts = (
        df.select(doc, *coarse, seq, piece.alias("_piece"), *extra)
        .groupBy(doc, *coarse, block.alias("_block"))
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(seq, "_piece"))), lambda e: e["_piece"]),
                separator,
            ).alias("_part"),
            F.sum("_tables").alias("_tables"),
        )
    )
    return parts.groupBy(doc).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*coarse, "_block", "_part"))), lambda e: e["_part"]
            ),
            separator,
        ).alias("text"),
        F.sum("_tables").cast("int").alias("table_count"),
    )


def assemble(elements: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Every element followed by a line break, with the number of tables."""
    tables = F.when(F.col("category") == "Table", 1).otherwise(0).alias("_tables")
    piece = F.concat("text", F.lit("\n"))
    return _joined(elements, doc, (seq,), piece, "", tables).select(
        doc, "text", (F.col("table_count") > 0).alias("has_tables"), "table_count"
    )


def flatten(elements: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """Non-blank paragraphs, then table rows as ``cell | cell``, separated by blank lines."""
    is_row = F.col("category") == "Table"
    rows = elements.where(is_row | (strip("text") != ""))
    piece = F.when(is_row, F.array_join("cells", " | ")).otherwise(F.col("text"))
    rows = rows.withColumn("_after", is_row.cast("int"))
    joined = _joined(rows, doc, ("_after", seq), piece, "\n\n", F.lit(0).alias("_tables"))
    return (
        elements.select(doc)
        .distinct()
        .join(joined, doc, "left")
        .select(doc, F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("char_count", F.length("text"))
    )


def parse_or_fail(df: DataFrame, parsed: Column, name: str = "text", mode: str = "FAILFAST") -> DataFrame:
    """Add a parsed column; where parsing gives null, fail the job or note it in ``_error``."""
    if mode == "FAILFAST":
        failed = F.raise_error(F.lit("document could not be parsed")).cast("string")
        return df.withColumn(name, F.coalesce(parsed, failed))
    if mode != "PERMISSIVE":
        raise ValueError("mode is FAILFAST or PERMISSIVE")
    out = df.withColumn(name, parsed)
    return out.withColumn("_error", F.when(F.col(name).isNull(), F.lit("document could not be parsed")))

"""Entity graph as two tables: merge of extracted nodes and edges, neighbourhood expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from stratadoc import fixed_values as fv
from stratadoc.functions.text import col, strip, tokens
from stratadoc.operators.fulltext import NameIndex, entity_lookup
from stratadoc.schemas import EXTRACTION
from stratadoc.session import durable

#: Names of this size are broadcast; a row takes so many bytes besides its name.
BROADCAST_BYTES = 32 << 20
NAME_BYTES = 32


def parse_extraction(df: DataFrame, payload: str = "payload", name: str = "extraction") -> DataFrame:
    """Add a struct of ``nodes`` and ``edges`` from JSON; missing lists and broken JSON give empty lists."""
    empty = F.from_json(F.lit('{"nodes":[],"edges":[]}'), EXTRACTION)
    # Two steps, so that each text is parsed once for both fields.
    lists = [F.coalesce(F.col("_x")[f], empty[f]).alias(f) for f in ("nodes", "edges")]
    parsed = df.withColumn("_x", F.from_json(col(payload), EXTRACTION))
    return parsed.withColumn(name, F.struct(*lists)).drop("_x")


def explode_nodes(df: DataFrame, order: list[str], extraction: str = "extraction") -> DataFrame:
    """``name, type, seq``: one row per extracted node; later rows have the larger ``seq``."""
    return df.select(*order, F.posexplode(f"{extraction}.nodes").alias("_pos", "_n")).select(
        F.col("_n.id").alias("name"), F.col("_n.type").alias("type"), F.struct(*order, "_pos").alias("seq")
    )


def explode_edges(df: DataFrame, extraction: str = "extraction") -> DataFrame:
    return df.select(F.explode(f"{extraction}.edges").alias("_e")).select("_e.source", "_e.target", "_e.type")


def keep_vocabulary(df: DataFrame, allowed: tuple[str, ...], column: str = "type") -> DataFrame:
    return df.where(F.col(column).isin(*allowed))


def merge_nodes(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per name; the type written last wins, and new rows come after existing ones."""
    rows = new.where(F.col("name").isNotNull()).select("name", "type", F.lit(1).alias("_new"), "seq")
    if existing is not None:
        no_seq = F.lit(None).cast(new.schema["seq"].dataType).alias("seq")
        rows = rows.unionByName(existing.select("name", "type", F.lit(0).alias("_new"), no_seq))
    # The last row of every name and type first, by the largest first field of its order among equal
    # other fields: a number that hash aggregation can hold, so that rows are not sorted by name.
    kind = new.schema["seq"].dataType
    fields = kind.fieldNames() if isinstance(kind, StructType) else []
    keys = [F.col("seq")[f].alias(f"_seq{n}") for n, f in enumerate(fields[1:], 1)]
    most = F.max(F.col("seq")[fields[0]] if fields else F.col("seq")).alias("_seq0")
    rows = rows.groupBy("name", "type", "_new", *keys).agg(most)
    # max_by would skip a null type only if its order were null, hence the struct around the type.
    order = F.struct("_new", *[f"_seq{n}" for n in range(len(fields) or 1)])
    last = F.max_by(F.struct("type"), order)
    return rows.groupBy("name").agg(last.alias("_t")).select("name", "_t.type")


def merge_edges(new: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct ``(source, target, type)`` whose two end points are nodes."""
    names = nodes.select("name")
    distinct = new.dropDuplicates(["source", "target", "type"])
    checked = distinct.join(names, distinct["source"] == names["name"], "left_semi")
    names = nodes.select("name")
    checked = checked.join(names, checked["target"] == names["name"], "left_semi")
    if existing is None:
        return checked
    return existing.unionByName(checked).dropDuplicates(["source", "target", "type"])


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge seen from either end, a self-loop once."""
    turned = edges.where(F.col("source") != F.col("target")).select(
        F.col("target").alias("source"), F.col("source").alias("target"), "type"
    )
    return edges.select("source", "target", "type").unionByName(turned)


def _expand(hits: DataFrame, edges: DataFrame, key: list[str], limit: int, constant_label: bool) -> DataFrame:
    """First ``limit`` rows per key over its ranked hits: score desc, source, relation, target.

    The hits come from a written table, so Spark broadcasts them if their true size allows.

    A name's edges are cut to its own first ``limit`` before the join: no later edge of that name can
    be among the first ``limit`` rows of a key, so a name that holds a third of all edges sends
    ``limit`` rows per task and hits are never multiplied by it.
    """
    edges = edges.withColumnRenamed("type", "rel")
    if constant_label:
        edges = edges.withColumn("rel", F.lit("RELATED"))
    asked = hits.select(F.col("name").alias("source")).distinct()
    # Up to a measured size the names are sent to the edges, so that no edge of another name moves.
    taken = asked.agg(F.sum(F.octet_length("source") + NAME_BYTES)).first()[0] or 0
    edges = edges.join(F.broadcast(asked) if taken <= BROADCAST_BYTES else asked, "source", "left_semi")
    per_source = Window.partitionBy("source").orderBy("rel", "target")
    first = edges.withColumn("_n", F.row_number().over(per_source)).where(F.col("_n") <= limit).drop("_n")
    joined = hits.withColumnRenamed("name", "source").drop("rank").join(first, "source")
    return joined.select(*key, "score", "source", "rel", "target")


def _first_rows(rows: DataFrame, key: str, limit: int, order: list) -> DataFrame:
    ranked = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def expand_directed(
    questions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *,
    question_id: str = "question_id",
    text: str = "text",
    limit: int = fv.GRAPH_CONTEXT_LIMIT,
    constant_label: bool = False,
    index: NameIndex | None = None,
) -> DataFrame:
    """Per question the first ``limit`` outgoing edges of its best matching names, as short texts.

    Every searchable name has an edge, so the best ``limit`` names always suffice.
    """
    with_edge = edges.select(F.col("source").alias("name")).distinct()
    hits = durable(
        entity_lookup(questions, nodes, question_id=question_id, text=text, k=limit, searchable=with_edge, index=index)
    )
    rows = _expand(hits, edges, [question_id], limit, constant_label)
    rows = _first_rows(rows, question_id, limit, [F.desc("score"), "source", "rel", "target"])
    return rows.select(
        question_id, "rank", "score", F.concat_ws(" ", "source", "rel", "target").alias("text")
    )


def expand_undirected(
    entities: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    *,
    question_id: str = "question_id",
    limit: int = fv.GRAPH_TOOL_LIMIT,
    constant_label: bool = False,
    index: NameIndex | None = None,
) -> DataFrame:
    """Per question the first ``limit`` edges, either way, of the names its entities match.

    ``entities`` has ``question_id, pos, entity``; a name matched by two entities counts twice.
    """
    either = both_directions(edges)
    asked = entities.withColumn("_ask", F.concat_ws("\u0001", F.col(question_id), F.col("pos")))
    with_edge = either.select(F.col("source").alias("name")).distinct()
    hits = durable(
        entity_lookup(asked, nodes, question_id="_ask", text="entity", k=limit, searchable=with_edge, index=index)
    )
    hits = hits.join(asked.select("_ask", question_id, "pos"), "_ask")
    rows = _expand(hits, either, [question_id, "pos"], limit, constant_label)
    return _first_rows(
        rows, question_id, limit, [F.desc("score"), "source", "rel", "target", "pos"]
    ).select(question_id, "rank", "source", "rel", "target")


def graph_tool_text(questions: DataFrame, entities: DataFrame, rows: DataFrame, question_id: str = "question_id") -> DataFrame:
    """Result of the graph tool per question: JSON rows, or the message that nothing was found."""
    asked = entities.groupBy(question_id).agg(F.count("entity").alias("_asked"))
    found = rows.groupBy(question_id).agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "source", "rel", "target"))),
                lambda r: F.struct(
                    r["source"].alias("source"), r["rel"].alias("rel"), r["target"].alias("target")
                ),
            )
        ).alias("_found")
    )
    text = (
        F.when(F.coalesce("_asked", F.lit(0)) == 0, F.lit(fv.NO_ENTITIES))
        .when(F.col("_found").isNull(), F.lit(fv.NO_CONNECTIONS))
        .otherwise(F.col("_found"))
    )
    return (
        questions.select(question_id)
        .join(asked, question_id, "left")
        .join(found, question_id, "left")
        .select(question_id, text.alias("result"))
    )


def parse_entities(df: DataFrame, payload: str = "payload", question_id: str = "question_id") -> DataFrame:
    """``question_id, pos, entity``: one row per name in ``{"entities": [...]}``, null where none."""
    names = F.from_json(col(payload), "entities array<string>")["entities"]
    return df.select(question_id, F.posexplode_outer(names).alias("pos", "entity"))


def gazetteer_extraction(
    chunks: DataFrame, gazetteer: DataFrame, key: list[str], text: str = "text"
) -> DataFrame:
    """Entities of a chunk found by rule: names of ``gazetteer(token, type)`` among its tokens.

    Each name is linked to the next different one in reading order, never all with all. The join has
    one gazetteer row per token; Spark broadcasts the gazetteer if its size allows.
    """
    words = chunks.select(*key, F.posexplode(tokens(text)).alias("_pos", "token"))
    first = words.join(gazetteer, "token").groupBy(*key, "token", "type").agg(F.min("_pos").alias("_pos"))
    found = first.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col("token").alias("id"), "type"))).alias("_f")
    )
    nodes = F.transform("_f", lambda f: F.struct(f["id"].alias("id"), f["type"].alias("type")))
    count = F.size("_f")
    edges = F.zip_with(
        F.slice("_f", 1, count - 1),
        F.slice("_f", 2, count - 1),
        lambda a, b: F.struct(a["id"].alias("source"), b["id"].alias("target"), F.lit("RELATES_TO").alias("type")),
    )
    return found.select(*key, F.struct(nodes.alias("nodes"), edges.alias("edges")).alias("extraction"))

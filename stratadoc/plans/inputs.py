"""Input tables of the registered queries, each derived from whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratadoc.functions.text import filename, url_path
from stratadoc.operators.conversation import message_lists
from stratadoc.operators.graph import explode_edges, explode_nodes, merge_edges, merge_nodes, parse_extraction
from stratadoc.session import durable
from stratadoc.sources.readers import spread

GRAPH_ORDER = ["doc_id", "chunk_index"]


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A given table; with columns named, only these are read and small scans are spread over all cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df.select(*columns)) if columns else df


def turns(spark, folder) -> DataFrame:
    """All turns with a session name and a turn name."""
    return table(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        "conv_id",
        "turn",
        F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        "role",
        F.col("text").alias("content"),
    )


def questions(spark, folder) -> DataFrame:
    """Every user turn is a question."""
    return turns(spark, folder).where(F.col("role") == "user").select(
        "question_id", "conv_id", "turn", "session_id", F.col("content").alias("text")
    )


def entity_questions(spark, folder) -> DataFrame:
    """Questions that also name a customer and a nation."""
    named = F.concat(
        "text",
        F.lit(" Customer#"),
        F.lpad(F.col("conv_id").cast("string"), 9, "0"),
        F.lit(" NATION_"),
        (F.col("conv_id") % 25).cast("string"),
    )
    return questions(spark, folder).withColumn("text", named)


def entity_payloads(spark, folder) -> DataFrame:
    """``payload``: the JSON a model gives for a question's entities; some empty, some broken."""
    customer = F.concat(F.lit("Customer#"), F.lpad(F.col("conv_id").cast("string"), 9, "0"))
    nation = F.concat(F.lit("NATION_"), (F.col("conv_id") % 25).cast("string"))
    good = F.to_json(F.struct(F.array(customer, nation).alias("entities")))
    kind = F.length("text") % 5
    payload = (
        F.when(kind == 0, F.lit('{"entities":[]}')).when(kind == 1, F.lit('{"entities":["N')).otherwise(good)
    )
    return questions(spark, folder).withColumn("payload", payload)


def answered(spark, folder) -> DataFrame:
    """Question turns with the assistant turn that follows."""
    t = turns(spark, folder)
    q = t.where(F.col("role") == "user")
    a = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer")
    )
    return q.join(a, ["conv_id", "turn"]).select(
        "question_id", "conv_id", "turn", "session_id", F.col("content").alias("question"), "answer"
    )


def plan_texts(asked: DataFrame) -> DataFrame:
    """``question, plan``: the JSON a model gives for a question; the text's length picks the kind."""
    head = F.col("text")
    kind = F.length("text") % 6
    lit = F.lit

    def plan(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    text = (
        F.when(kind == 0, plan(action=lit("retrieve"), refined_query=head, reasoning=lit("look it up")))
        .when(
            kind == 1,
            plan(
                action=lit("tool_use"), refined_query=head, tool_choice=lit(" graph_search "),
                tool_input=F.concat(lit("  "), "question_id", lit(" ")),
            ),
        )
        .when(kind == 2, plan(action=lit("tool_use"), refined_query=head, tool_choice=lit("vector_search")))
        .when(kind == 3, plan(action=lit("direct_answer"), tool_choice=lit("calculator"), tool_input=lit("1+1")))
        .when(kind == 4, F.concat(lit("Sure: "), plan(action=lit("retrieve"), refined_query=head)))
        .otherwise(plan(refined_query=head, tool_choice=lit("web_search")))
    )
    return asked.withColumn("plan", text).withColumnRenamed("text", "question")


def tool_states(spark, folder) -> DataFrame:
    """Per conversation all turns as messages; every third turn is a tool's output."""
    t = turns(spark, folder)
    marked = F.when(
        F.col("turn") % 3 == 1, F.concat(F.lit("Tool Output:  "), "content", F.lit("\n"))
    ).otherwise(F.col("content"))
    packed = message_lists(t.withColumn("content", marked), "session_id", ["turn"])
    conv = F.substr("session_id", F.lit(2)).cast("long")
    return packed.select(
        "session_id",
        "messages",
        F.when(conv % 2 == 0, F.lit("vector_search")).otherwise(F.lit("")).alias("tool_choice"),
        F.array(F.concat(F.lit("fact "), "session_id"), F.lit("second fact")).alias("documents"),
        F.concat(F.lit("What of "), "session_id", F.lit("?")).alias("current_query"),
    )


def page_files(spark, folder) -> DataFrame:
    """Pages with the file name their URL path gives."""
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    return pages.withColumn("filename", filename(url_path("url"), "page_id"))


def documents(spark, folder) -> DataFrame:
    """Documents with a file name."""
    docs = table(spark, folder, "documents", "doc_id", "source", "lang", "text")
    return docs.withColumn(
        "filename", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    )


def _graph_rows(spark, folder) -> DataFrame:
    """``doc_id, chunk_index, extraction, broken``: one extraction for every row of the star schema.

    Suppliers in debt count as broken, so edges to them lack an end point; customers of one market
    segment carry a type outside the vocabulary; a part's type changes from row to row.
    """
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    names = nation.select("n_nationkey", "n_name")
    supplier = table(spark, folder, "supplier")
    customer = table(spark, folder, "customer")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    lines = table(
        spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )

    def node(name, kind):
        return F.struct(name.alias("id"), kind.alias("type"))

    def extraction(nodes, source, target, kind):
        edge = F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
        return F.struct(F.array(*nodes).alias("nodes"), F.array(edge).alias("edges")).alias("extraction")

    c, lit = F.col, F.lit
    part_name = F.concat("p_name", lit("#"), c("p_partkey").cast("string"))
    sound = lit(False).alias("broken")
    rows = [
        nation.select(
            c("n_nationkey").cast("long").alias("doc_id"),
            extraction(
                [node(c("n_name"), lit("Location")), node(c("r_name"), lit("Location"))],
                c("n_name"), c("r_name"), "PART_OF",
            ),
            sound,
        ),
        supplier.join(names, c("s_nationkey") == c("n_nationkey")).select(
            (c("s_suppkey") + 1_000_000_000_000).alias("doc_id"),
            extraction([node(c("s_name"), lit("Organization"))], c("s_name"), c("n_name"), "LOCATED_IN"),
            (c("s_acctbal") < 0).alias("broken"),
        ),
        customer.join(names, c("c_nationkey") == c("n_nationkey")).select(
            (c("c_custkey") + 2_000_000_000_000).alias("doc_id"),
            extraction(
                [node(c("c_name"), F.when(c("c_mktsegment") == "MACHINERY", lit("Company")).otherwise(lit("Organization")))],
                c("c_name"), c("n_name"), "LOCATED_IN",
            ),
            sound,
        ),
        lines.join(part, c("l_partkey") == c("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name"), c("l_suppkey") == c("s_suppkey"))
        .select(
            (c("l_orderkey") * 8 + c("l_linenumber") + 3_000_000_000_000).alias("doc_id"),
            extraction(
                [node(part_name, F.when(c("l_returnflag") == "R", lit("Concept")).otherwise(lit("Product")))],
                part_name, c("s_name"), "CREATED_BY",
            ),
            sound,
        ),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.withColumn("chunk_index", F.lit(0))


def graph_payloads(spark, folder) -> DataFrame:
    """``doc_id, chunk_index, payload``: the extractions as JSON text, broken ones with a stray brace."""
    text = F.to_json("extraction")
    payload = F.when(F.col("broken"), F.concat(F.lit("{"), text)).otherwise(text)
    return _graph_rows(spark, folder).select(*GRAPH_ORDER, payload.alias("payload"))


def extractions(spark, folder) -> DataFrame:
    """Extractions parsed from their JSON, written since nodes and edges both read them."""
    return durable(parse_extraction(graph_payloads(spark, folder)).select(*GRAPH_ORDER, "extraction"))


def graph_names(spark, folder) -> DataFrame:
    """Nodes of the merged graph alone."""
    found = _graph_rows(spark, folder).where(~F.col("broken"))
    return durable(merge_nodes(explode_nodes(found, GRAPH_ORDER)))


def graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the merged graph, written to the shared folder since many steps read them."""
    found = _graph_rows(spark, folder).where(~F.col("broken"))
    nodes = durable(merge_nodes(explode_nodes(found, GRAPH_ORDER)))
    return nodes, durable(merge_edges(explode_edges(found), nodes))

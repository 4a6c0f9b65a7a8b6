"""Graph merge and expansion."""

import json

import pytest
from pyspark.sql import functions as F

from stratadoc import fixed_values as fv
from stratadoc.operators import graph as g

NODES = "name string, type string, seq long"
EDGES = "source string, target string, type string"


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_extraction_defaults(spark):
    rows = [('{"nodes":[{"id":"a","type":"Person"}]}',), ("broken",), ('{"edges":[]}',), (None,)]
    parsed = g.parse_extraction(spark.createDataFrame(rows, "payload string")).select("extraction.*").collect()
    assert [len(r["nodes"]) for r in parsed] == [1, 0, 0, 0] and all(r["edges"] == [] for r in parsed)


def test_last_type_wins_and_merge_is_idempotent(spark):
    new = spark.createDataFrame([("a", "Person", 1), ("a", "Event", 2), ("b", None, 3), (None, "Event", 4)], NODES)
    old = spark.createDataFrame([("a", "Concept"), ("c", "Product")], "name string, type string")
    once = g.merge_nodes(new, old)
    assert sorted(map(str, pairs(once, "name", "type"))) == sorted(map(str, [("a", "Event"), ("b", None), ("c", "Product")]))
    twice = g.merge_nodes(new, once)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_merge_holds_numbers_while_it_reads(spark):
    """Rows meet in a hash aggregation first, not sorted by name; the order is that of whole structs."""
    rows = [("a", "X", 2, 0, 1), ("a", "Y", 2, 1, 0), ("a", "X", 1, 9, 9), ("b", None, 5, 0, 0), ("b", "X", None, 9, 0), ("c", "X", None, None, 0)]
    new = spark.createDataFrame(rows, "name string, type string, d long, c int, p int").selectExpr("name", "type", "struct(d, c, p) seq")
    merged = g.merge_nodes(new)
    assert sorted(map(str, pairs(merged, "name", "type"))) == sorted(map(str, [("a", "Y"), ("b", None), ("c", "X")]))
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "partial_max(" in plan


def test_edges_need_both_ends_and_are_kept_once(spark):
    nodes = spark.createDataFrame([("a", "t"), ("b", "t")], "name string, type string")
    new = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R"), ("a", "x", "R"), ("y", "a", "R"), ("a", "a", "S")], EDGES)
    once = g.merge_edges(new, nodes)
    assert pairs(once, "source", "target", "type") == [("a", "a", "S"), ("a", "b", "R")]
    assert pairs(g.merge_edges(new, nodes, once), "source", "target", "type") == pairs(once, "source", "target", "type")


def test_vocabulary(spark):
    df = spark.createDataFrame([("a", "Person"), ("b", "Company")], "name string, type string")
    assert pairs(g.keep_vocabulary(df, fv.NODE_LABELS), "name") == [("a",)]


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([(n, "t") for n in ("hub one", "spoke two", "lone three", "end four")], "name string, type string")
    edges = spark.createDataFrame(
        [("hub one", "spoke two", "A"), ("hub one", "hub one", "B"), ("spoke two", "end four", "A")]
        + [("hub one", f"n{i:04d}", "Z") for i in range(1000)],
        EDGES,
    )
    return nodes, edges


def test_directed(spark, small):
    q = spark.createDataFrame([("q1", "the hub"), ("q2", "lone"), ("q3", "two one")], "question_id string, text string")
    rows = pairs(g.expand_directed(q, *small), "question_id", "rank", "text")
    assert [r for r in rows if r[0] == "q1"] == [
        ("q1", 1, "hub one A spoke two"), ("q1", 2, "hub one B hub one"), ("q1", 3, "hub one Z n0000"),
        ("q1", 4, "hub one Z n0001"), ("q1", 5, "hub one Z n0002"),
    ]
    assert not [r for r in rows if r[0] == "q2"] and len([r for r in rows if r[0] == "q3"]) == 5
    label = g.expand_directed(q, *small, constant_label=True).where("question_id = 'q1' and rank = 1").first()
    assert label["text"] == "hub one RELATED hub one"


def test_undirected_shows_a_loop_once(spark, small):
    asked = spark.createDataFrame([("q", 0, "two"), ("q", 1, "four"), ("l", 0, "hub")], "question_id string, pos int, entity string")
    rows = pairs(g.expand_undirected(asked, *small), "question_id", "rank", "source", "rel", "target")
    assert [r[2:] for r in rows if r[0] == "q"] == [
        ("end four", "A", "spoke two"), ("spoke two", "A", "end four"), ("spoke two", "A", "hub one"),
    ]
    loops = [r for r in rows if r[0] == "l" and r[3] == "B"]
    assert len(loops) == 1 and len([r for r in rows if r[0] == "l"]) == 10


def test_hot_name_is_cut_before_the_join(spark, small):
    q = spark.createDataFrame([("q", "hub")], "question_id string, text string")
    plan = g.expand_directed(q, *small)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_tool_text(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "question_id string")
    entities = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", None, None)], "question_id string, pos int, entity string")
    rows = spark.createDataFrame([("a", 1, "s", "r", "t")], "question_id string, rank int, source string, rel string, target string")
    got = {r["question_id"]: r["result"] for r in g.graph_tool_text(q, entities, rows).collect()}
    assert json.loads(got["a"]) == [{"source": "s", "rel": "r", "target": "t"}]
    assert (got["b"], got["c"]) == (fv.NO_CONNECTIONS, fv.NO_ENTITIES)


def test_entity_lists(spark):
    df = spark.createDataFrame([("a", '{"entities":["x","y"]}'), ("b", "{}"), ("c", "no")], "question_id string, payload string")
    got = [(r["question_id"], r["entity"]) for r in g.parse_entities(df).orderBy("question_id", "pos").collect()]
    assert got == [("a", "x"), ("a", "y"), ("b", None), ("c", None)]


def test_rule_extraction_links_neighbours_only(spark):
    chunks = spark.createDataFrame([(1, 0, "red then blue then green, red")], "doc_id long, chunk_index int, text string")
    gazetteer = spark.createDataFrame([(t, "Concept") for t in ("red", "blue", "green")], "token string, type string")
    out = g.gazetteer_extraction(chunks, gazetteer, ["doc_id", "chunk_index"])
    assert pairs(g.explode_edges(out), "source", "target", "type") == [("blue", "green", "RELATES_TO"), ("red", "blue", "RELATES_TO")]
    assert out.select(F.size("extraction.nodes").alias("n")).first()["n"] == 3

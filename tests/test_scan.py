"""What a scan costs besides its pairs."""

from pyspark.sql import functions as F

from stratadoc.operators import ranked_scan
from stratadoc.operators.embedding import embed_hashed
from stratadoc.operators.vector_search import vector_topk


def test_items_are_embedded_once(spark):
    """A filter on the vector before the scan would have the embedding worked out for it once more."""
    items = embed_hashed(spark.createDataFrame([("p", "alpha"), ("r", "beta"), ("s", None), ("t", "")], "point_id string, text string"))
    asked = embed_hashed(spark.createDataFrame([("q", "alpha")], "question_id string, text string"))
    for way in ({}, {"broadcast_bytes": 0, "question_block": 2, "item_block": 2}):
        hits = vector_topk(asked, items, k=5, **way)
        assert sorted((r["point_id"], r["score"]) for r in hits.collect()) == [("p", 1.0), ("r", 0.0), ("t", 0.0)]
        if not way:
            assert hits._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_items_without_a_vector_are_left_out(spark):
    rows = [(1, None), (2, []), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    items = spark.createDataFrame(rows, "point_id long, embedding array<double>")
    asked = items.withColumnRenamed("point_id", "question_id")
    for way in ({}, {"broadcast_bytes": 0, "question_block": 1, "item_block": 1}):
        found = vector_topk(asked, items, k=3, **way).collect()
        assert sorted((r["question_id"], r["point_id"], r["rank"]) for r in found) == [(3, 3, 1), (3, 4, 2), (4, 3, 2), (4, 4, 1)]
        assert vector_topk(asked, items.where("point_id < 3"), k=3, **way).count() == 0


def test_every_cell_has_its_own_task(spark):
    for tasks in (1, 7, 48):
        keys = ranked_scan._keys_of_tasks(spark, tasks)
        named = spark.createDataFrame([(k,) for k in keys], "k int").repartition(tasks, "k")
        assert len(set(keys)) == tasks and sorted(r["p"] for r in named.select(F.spark_partition_id().alias("p")).collect()) == list(range(tasks))


def test_cells_of_one_scan_do_not_meet(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(3_000)], "point_id long, embedding array<double>")
    hits = vector_topk(v.withColumnRenamed("point_id", "question_id"), v, k=1, broadcast_bytes=0, question_block=500, item_block=500)
    assert hits.count() == 3_000
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [_cell") == 2

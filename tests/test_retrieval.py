"""Top-k searches against brute force, both ways of execution, and what is built on them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratadoc.functions.vectors import dot, normalise
from stratadoc.operators.embedding import embed_hashed, embed_with, hashed_vector
from stratadoc.operators import embedding, fulltext, kernels
from stratadoc.operators.fulltext import entity_lookup
from stratadoc.operators.retrieval import citations, documents_per_question, graph_contexts, merge_contexts, vector_contexts
from stratadoc.operators.kernels import CosineKernel
from stratadoc.operators.vector_index import vector_index
from stratadoc.operators.vector_search import above_threshold, cache_lookup, drop_missing_vectors, search_tool_text, vector_topk

# A limit of zero bytes forces the way without broadcast; small blocks make many cells.
WAYS = [{}, {"broadcast_bytes": 0, "question_block": 7, "item_block": 40}]


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return math.floor(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)) * 1e9 + 0.5) / 1e9


def vectors(seed, n, hot):
    rng = random.Random(seed)
    copy = [rng.gauss(0, 1) for _ in range(8)]
    return [(i, copy if rng.random() < hot else [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(n)]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("match_on,threshold", [(None, None), ("label", None), (None, 0.5)])
def test_vector_topk_is_exact(spark, way, match_on, threshold):
    questions, items = vectors(1, 20, 0.3), vectors(2, 200, 1 / 3)
    q = spark.createDataFrame(questions, "question_id long, embedding array<double>, label int")
    v = spark.createDataFrame(items, "point_id long, embedding array<double>, label int").repartition(5)
    got = vector_topk(q, v, k=4, match_on=match_on, threshold=threshold, **way)
    expected = set()
    for qid, qv, label in questions:
        scored = [
            (-cosine(qv, iv), iid)
            for iid, iv, other in items
            if (match_on is None or label == other) and (threshold is None or cosine(qv, iv) >= threshold)
        ]
        expected |= {(qid, iid, rank + 1) for rank, (_, iid) in enumerate(sorted(scored)[:4])}
    assert {(r["question_id"], r["point_id"], r["rank"]) for r in got.collect()} == expected


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("cells", [1, 7, 40])
@pytest.mark.parametrize("match_on,threshold,skip", [(None, None, False), ("label", None, True), (None, 0.5, False)])
def test_search_by_cells_is_exact(spark, way, cells, match_on, threshold, skip):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    near = lambda c: [x + rng.gauss(0, 0.1) for x in c]
    items = [(i, near(rng.choice(centres)) if i % 3 else centres[0], i % 3) for i in range(240)] + [(900, None, 1), (901, [0.0] * 8, 2)]
    questions = [(i, near(rng.choice(centres)) if i % 4 else [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(30)]
    schema = "embedding array<double>, label int"
    q = spark.createDataFrame(questions, f"question_id long, {schema}")
    v = spark.createDataFrame(items, f"point_id long, {schema}").repartition(3)
    options = {"k": 4, "match_on": match_on, "threshold": threshold, "skip_same": skip, **way}
    found = lambda it: sorted(tuple(r) for r in vector_topk(q, it, **options).collect())
    index = vector_index(v, keep=("label",), cells=cells)
    assert found(index) == found(v)
    some = {"k": 4, "filters": {"label": 1}}
    assert sorted(map(tuple, vector_topk(q, index, **some).collect())) == sorted(map(tuple, vector_topk(q, v, **some).collect()))


def test_cells_are_left_out(spark):
    """Clusters apart from each other: a question touches few items, and a task emits little."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    vectors = np.repeat(centres, 50, axis=0) + 0.01 * rng.standard_normal((1000, 16))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(vectors)], "point_id long, embedding array<double>")
    index = vector_index(v, cells=200)
    table = index.items.toArrow()
    asked = pa.table({"question_id": [0], "embedding": [vectors[0].tolist()]})
    settings = {"question_id": "question_id", "item_id": "point_id", "vector": "embedding", "k": 3, "threshold": None, "skip_same": False, "match_on": None}
    kernel = CosineKernel(asked, **settings, cells=index.plain())
    for batch in table.to_batches(max_chunksize=100):
        kernel.update(batch)
    assert kernel.scored <= 100 and len(kernel.best()[1]) == 3


@pytest.mark.parametrize("way", WAYS)
def test_filters_null_match_and_missing_vectors(spark, way):
    v = spark.createDataFrame(
        [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, None, "a"), (4, [], "a")],
        "point_id long, embedding array<double>, lang string",
    )
    q = spark.createDataFrame([("x", [1.0, 0.0], None), ("y", [1.0, 0.0], "b")], "question_id string, embedding array<double>, lang string")
    rows = vector_topk(q, v, match_on="lang", **way).collect()
    assert {(r["question_id"], r["point_id"], r["rank"]) for r in rows} == {("x", 1, 1), ("x", 2, 2), ("y", 2, 1)}
    rows = vector_topk(q.drop("lang"), v, filters={"lang": "a"}, **way).collect()
    assert {(r["question_id"], r["point_id"]) for r in rows} == {("x", 1), ("y", 1)}
    assert drop_missing_vectors(v).count() == 2


def test_dimensions_must_agree(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "point_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimension"):
        vector_topk(q, v).collect()


def test_no_questions(spark):
    q = spark.createDataFrame([], "question_id long, embedding array<double>")
    v = spark.createDataFrame([(1, [1.0])], "point_id long, embedding array<double>")
    assert vector_topk(q, v).count() == 0


def test_ranks_have_no_gaps_and_plan_prunes_early(spark):
    q = spark.createDataFrame(vectors(3, 10, 0.2), "question_id long, embedding array<double>, label int")
    v = spark.createDataFrame(vectors(4, 50, 0.2), "point_id long, embedding array<double>, label int")
    hits = vector_topk(q, v, k=5)
    plan = hits._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    ranks = hits.groupBy("question_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r["r"] == [1, 2, 3, 4, 5] for r in ranks)


def test_payload_is_not_shuffled_for_a_few_hits(spark, tmp_path):
    q = spark.createDataFrame(vectors(3, 10, 0.2), "question_id long, embedding array<double>, label int")
    v = spark.createDataFrame(vectors(4, 50, 0.2), "point_id long, embedding array<double>, label int")
    v.select("point_id", F.lit("t").alias("text"), F.lit("f").alias("filename"), F.lit("unused").alias("x")).write.parquet(str(tmp_path / "p"))
    contexts = vector_contexts(
        vector_topk(q, v), spark.read.parquet(str(tmp_path / "p")), question_id="question_id", item_id="point_id"
    )
    plan = contexts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "ReadSchema: struct<point_id:bigint,text:string,filename:string>" in plan


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = [r["u"] for r in df.select(normalise("v").alias("u")).collect()]
    assert rows == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(dot("v", "v").alias("d")).first()["d"] == 25.0


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("To be, or not TO be",), ("",), (None,), ("é ü",)], "text string")
    rows = [r["v"] for r in df.select(hashed_vector("text", unit=False).alias("v")).collect()]
    assert sum(rows[0]) == 6 and max(rows[0]) >= 2 and sum(rows[1]) == 0 and rows[2] is None and sum(rows[3]) == 2
    unit = df.select(hashed_vector("text").alias("v")).first()["v"]
    assert abs(sum(x * x for x in unit) - 1) < 1e-12


def test_hashed_rows_are_counted_together(monkeypatch):
    texts = pa.array(["b a B", None, "", "a c"], pa.string())
    passes, count = [], np.bincount
    monkeypatch.setattr(embedding.np, "bincount", lambda *a, **k: (passes.append(1), count(*a, **k))[1])
    found = embedding._hashed_rows(texts, embedding._Buckets(16), False).to_pylist()
    assert len(passes) == 1 and found[1] is None
    plain = [embedding.hashed_counts(t, 16).tolist() for t in ("b a B", "", "a c")]
    assert [found[0], *found[2:]] == plain
    assert embedding._hashed_rows(pa.array([None], pa.string()), embedding._Buckets(16), True).to_pylist() == [None]
    assert len(embedding._hashed_rows(pa.array([], pa.string()), embedding._Buckets(16), True)) == 0


def test_user_model_and_its_failures(spark):
    def make():
        def model(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return [[len(t), 0.0] for t in texts]

        return model

    df = spark.createDataFrame([("a",), ("bb",), ("bad",)], "text string").coalesce(1)
    rows = embed_with(df, make, batch_size=1, mode="PERMISSIVE", unit=False).collect()
    assert [r["embedding"] for r in rows] == [[1.0, 0.0], [2.0, 0.0], None]
    with pytest.raises(Exception, match="bad text"):
        embed_with(df, make).collect()


def test_cache_hit_and_miss(spark):
    cache = spark.createDataFrame(
        [("e1", "a1", [1.0, 0.0], "u"), ("e0", "a0", [1.0, 0.0], "v")], "entry_id string, answer string, embedding array<double>, user string"
    )
    asked = spark.createDataFrame([(1, [2.0, 0.0], "u"), (2, [0.0, 1.0], "u")], "question_id long, embedding array<double>, user string")
    rows = {r["question_id"]: (r["hit"], r["answer"]) for r in cache_lookup(asked, cache).collect()}
    assert rows == {1: (True, "a0"), 2: (False, None)}
    rows = {r["question_id"]: r["answer"] for r in cache_lookup(asked, cache, scope="user").collect()}
    assert rows == {1: "a1", 2: None}


def test_threshold_is_inclusive(spark):
    hits = spark.createDataFrame([(0.95,), (0.9499,)], "score double")
    assert above_threshold(hits).count() == 1


def test_tool_text_and_citations(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "question_id long, point_id long, rank int")
    payload = spark.createDataFrame(
        [(10, "t" * 300, "f.txt", 0), (11, "u", None, None)], "point_id long, text string, filename string, page int"
    )
    rows = {r["question_id"]: r["result"] for r in search_tool_text(q, hits, payload, question_id="question_id", item_id="point_id").collect()}
    assert rows == {
        1: "- Content: " + "t" * 200 + "... [Source: f.txt, Page: 0]\n- Content: u... [Source: Unknown, Page: N/A]\n",
        2: "No relevant documents found.",
    }
    cited = citations(hits, payload.na.fill({"filename": "g"}), question_id="question_id", item_id="point_id").first()
    assert cited["citations"] == [{"source": "f.txt", "text": "t" * 300}, {"source": "g", "text": "u"}]


def bm25(questions, names):
    tokens = {n: re.findall(r"[^\W_]+", n.lower()) for n in names}
    mean = sum(map(len, tokens.values())) / len(names)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    for qid, text in questions:
        for name, ts in tokens.items():
            score = 0.0
            for t in set(re.findall(r"[^\W_]+", text.lower())) & set(ts):
                idf = math.log(1 + (len(names) - df[t] + 0.5) / (df[t] + 0.5))
                tf = ts.count(t)
                score += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ts) / mean))
            if score > 0:
                yield qid, name, math.floor(score * 1e6 + 0.5) / 1e6


def test_lookup_reads_index_and_searchable_names_once(spark, monkeypatch):
    """Only rows of asked tokens go on, so later steps do not grow with all names."""
    nodes = spark.createDataFrame([(f"thing {i}",) for i in range(40)] + [("lone star",)], "name string")
    some = fulltext.durable(nodes.where("name <> 'thing 7'"))
    index = fulltext.name_index(nodes, 5)
    q = spark.createDataFrame([(1, "thing 3"), (2, "thing 7")], "question_id int, text string")
    read, real = [], fulltext.durable

    def seen(df):
        read.append(set(df.inputFiles()))
        out = real(df)
        if "add" in df.columns:
            assert {r["token"] for r in out.collect()} == {"thing", "3"}
        return out

    monkeypatch.setattr(fulltext, "durable", seen)
    got = entity_lookup(q, nodes, k=1, index=index, searchable=some)
    read.append(set(got.inputFiles()))
    assert sorted((r["question_id"], r["name"]) for r in got.collect()) == [(1, "thing 3"), (2, "thing 0")]
    for files in (index.postings.inputFiles(), some.inputFiles()):
        assert sum(bool(one & set(files)) for one in read) == 1


@pytest.mark.parametrize("hot_names", [1, 12, 40, 10_000])
def test_entity_lookup_is_exact(spark, hot_names):
    """Rare tokens alone, hot tokens alone, and both; the limit moves tokens from one way to the other."""
    rng = random.Random(5)
    words = ["node", "pod", "volume", "alpha", "beta", "gamma", "x1"] + [f"r{i}" for i in range(30)]
    # One token occurs in a third of all names.
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4)) + (["hot"] if rng.random() < 1 / 3 else [])) for _ in range(150)})
    questions = [(f"q{i}", " ".join(rng.choices(words + ["hot", "zzz"], k=4))) for i in range(15)] + [("none", "???")]
    expected = set()
    for qid, _ in questions:
        scored = sorted((-s, n) for q, n, s in bm25(questions, names) if q == qid)[:6]
        expected |= {(qid, n, rank + 1) for rank, (_, n) in enumerate(scored)}
    q = spark.createDataFrame(questions, "question_id string, text string")
    nodes = spark.createDataFrame([(n, "t") for n in names], "name string, type string").repartition(3)
    got = entity_lookup(q, nodes, k=6, hot_names=hot_names)
    assert {(r["question_id"], r["name"], r["rank"]) for r in got.collect()} == expected
    some = spark.createDataFrame([(n,) for n in names[::3]], "name string")
    expected = set()
    for qid, _ in questions:
        scored = sorted((-s, n) for q, n, s in bm25(questions, names) if q == qid and n in names[::3])[:6]
        expected |= {(qid, n, rank + 1) for rank, (_, n) in enumerate(scored)}
    got = entity_lookup(q, nodes, k=6, hot_names=hot_names, searchable=some)
    assert {(r["question_id"], r["name"], r["rank"]) for r in got.collect()} == expected


def test_hybrid_merge(spark):
    vector = spark.createDataFrame([(1, 0, 1, "same"), (1, 0, 2, "v")], "question_id long, branch int, rank int, text string")
    graph = graph_contexts(spark.createDataFrame([(1, 1, "g"), (1, 2, "same")], "question_id long, rank int, text string"), question_id="question_id")
    merged = merge_contexts(vector, graph, question_id="question_id")
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    rows = {r["question_id"]: r["documents"] for r in documents_per_question(q, merged, question_id="question_id").collect()}
    assert rows == {1: ["same", "v", "g"], 2: []}


def test_question_and_document_share_one_space(spark):
    df = spark.createDataFrame([(1, "spark reads parquet")], "question_id long, text string")
    items = df.withColumnRenamed("question_id", "point_id")
    assert vector_topk(embed_hashed(df), embed_hashed(items)).first()["score"] == 1.0


def _vectors(rng, name, n):
    return pa.table({name: [f"{i:05d}" for i in range(n)], "embedding": rng.standard_normal((n, 16)).tolist()})


SEARCH = {"question_id": "question_id", "item_id": "point_id", "vector": "embedding", "threshold": None, "skip_same": False, "match_on": None}


def test_single_precision_only_chooses_what_is_scored():
    """Near ties beyond single precision keep their order; copies in crowds go to smaller ids."""
    rng = np.random.default_rng(5)
    asked, base = _vectors(rng, "question_id", 40), rng.standard_normal((30, 16))
    items = np.concatenate([base + 1e-8 * rng.standard_normal((30, 16)) for _ in range(20)] + [np.repeat(base[:1], 900, axis=0)])
    ids = [f"p{i:05d}" for i in rng.permutation(len(items))]
    table = pa.table({"point_id": ids, "embedding": items.tolist()})
    kernel = CosineKernel(asked, k=6, **SEARCH)
    for batch in table.to_batches(max_chunksize=300):
        kernel.update(batch)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    scores = np.floor(unit(np.array(asked["embedding"].to_pylist())) @ unit(items).T * 1e9 + 0.5) / 1e9
    expected = {(f"{q:05d}", ids[i]) for q in range(40) for i in sorted(range(len(ids)), key=lambda i: (-scores[q, i], ids[i]))[:6]}
    assert set(zip(*kernel.best()[:2])) == expected


def test_tiles_of_a_stretch_are_merged_together(monkeypatch):
    rng = np.random.default_rng(8)
    q, v = rng.normal(size=(1_300, 8)), rng.normal(size=(2_500, 8))
    v[1_500, 0] = np.nan  # hides no other item
    asked = pa.table({"question_id": pa.array(range(len(q)), pa.int64()), "embedding": pa.array(q.tolist())})
    items = pa.table({"point_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(v.tolist())}).combine_chunks()
    merges, merge = [], kernels._Best.merge
    monkeypatch.setattr(kernels._Best, "merge", lambda best, *found: (merges.append(len(found[0])), merge(best, *found)))
    kernel = CosineKernel(asked, k=6, **SEARCH)
    kernel.update(items.to_batches()[0])
    assert len(merges) == 3 and sum(merges) < 100 * len(q)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    scores = np.floor(unit(q) @ unit(v).T * 1e9 + 0.5) / 1e9
    scores[:, 1_500] = -2
    best = {(n, i) for n, row in enumerate(scores) for i in np.lexsort((np.arange(len(v)), -row))[:6].tolist()}
    assert set(zip(*(part.tolist() for part in kernel.best()[:2]))) == best


def test_cells_hold_no_matrix_of_questions_and_cells():
    rng = np.random.default_rng(6)
    asked, sample = _vectors(rng, "question_id", 2_000), _vectors(rng, "point_id", 500)
    kernel = CosineKernel(asked, k=3, **SEARCH, cells={"sample": sample, "radius": np.full(500, 0.3)})
    assert all(getattr(v, "size", 0) < 2_000 * 500 for v in vars(kernel).values())


def test_blocks_move_packs(spark, monkeypatch):
    """Rows are copied once per block of the other side, and a block holds as many as its size says, not 8,192."""
    from stratadoc.operators import ranked_scan

    counts = []
    real = ranked_scan.durable
    monkeypatch.setattr(ranked_scan, "durable", lambda df: counts.append(real(df)) or counts[-1])
    rows = [(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(3_000)]
    v = spark.createDataFrame(rows, "point_id long, embedding array<double>").coalesce(1)
    q = v.withColumnRenamed("point_id", "question_id")
    hits = vector_topk(q, v, k=1, broadcast_bytes=0)
    assert hits.count() == 3_000
    assert [(r["n"], r["s"]) for r in counts[0].selectExpr("count(*) n", "sum(rows) s").collect()] == [(3, 3_000)]

"""The long paths without SQL counterpart, against a plain computation on small tables."""

import hashlib
import math
import re

import numpy as np
from plain import split_recursive

from stratadoc import fixed_values as fv
from stratadoc.operators.embedding import embed_hashed
from stratadoc.plans import answer, catalog

SMALL = "/root/testdata/sf0.001"


def embed(text):
    v = np.zeros(64)
    for token in re.findall(r"[^\W_]+", text.lower()):
        v[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += 1
    return v / (np.linalg.norm(v) or 1)


def page_text(page):
    page = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "\n", page)
    page = re.sub(r"(?s)<[^>]*>", "\n", re.sub(r"(?s)<!--.*?-->", "\n", page))
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        page = page.replace(f"&{name};", char)
    return "\n".join(p.strip() for p in re.split(r"\n|  ", page) if p.strip())


def test_page_contexts_against_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    points = {}
    for page in pages:
        path = re.match(r"[a-z]+://[^/?#]*([^?#]*)", page["url"]).group(1)
        name = path.split("/")[-1] if path else f"object_{page['page_id']}"
        for i, chunk in enumerate(split_recursive(page_text(page["html"]), 512, 50, fv.SEPARATORS)):
            key = "\u0001".join([name, str(i), hashlib.md5(chunk.encode()).hexdigest()])
            points[hashlib.md5(key.encode()).hexdigest()] = (chunk, name)
    ids = sorted(points)
    matrix = np.array([embed(points[i][0]) for i in ids])
    expected = set()
    for row in spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'user'").collect():
        scores = [math.floor(float(s) * 1e9 + 0.5) / 1e9 for s in matrix @ embed(row["text"])]
        best = sorted(zip((-s for s in scores), ids))[:5]
        expected |= {
            (f"{row['conv_id']}-{row['turn']}", rank + 1, f"{points[i][0]} [Source: {points[i][1]}]") for rank, (_, i) in enumerate(best)
        }
    got = catalog.page_contexts(spark, SMALL).collect()
    assert {(r["question_id"], r["rank"], r["text"]) for r in got} == expected


def test_recursive_chunks_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = {
        (d["doc_id"], i, c) for d in docs for i, c in enumerate(split_recursive(d["text"], 512, 50, fv.SEPARATORS))
    }
    assert {tuple(r) for r in catalog.chunk_recursive(spark, SMALL).select("doc_id", "chunk_index", "text").collect()} == expected


def test_answer_prompts_end_to_end(spark):
    texts = [("p1", "the scheduler places pods on nodes", "a.txt", 0), ("p2", "a volume stores data", "b.txt", 0)]
    points = embed_hashed(spark.createDataFrame(texts, "point_id string, text string, filename string, page int"))
    cache = embed_hashed(spark.createDataFrame([("e", "known question here", "known answer")], "entry_id string, text string, answer string"))
    nodes = spark.createDataFrame([("scheduler", "Concept"), ("kubelet", "Concept")], "name string, type string")
    edges = spark.createDataFrame([("scheduler", "kubelet", "RELATES_TO")], "source string, target string, type string")
    asked = spark.createDataFrame(
        [
            ("hit", "known question here", "{}"),
            ("find", "who places pods", '{"action":"retrieve","refined_query":"scheduler places pods"}'),
            ("tool", "what is 1+1", '{"action":"tool_use","tool_choice":"calculator","tool_input":"1+1"}'),
            ("bad", "a volume", "not json"),
            ("vector", "stored data", '{"action":"tool_use","tool_choice":"vector_search"}'),
            ("graph", "tell me", '{"action":"tool_use","tool_choice":"graph_search","tool_input":"the scheduler"}'),
            ("none", "tell me", '{"action":"tool_use","tool_choice":"graph_search","tool_input":"nobody"}'),
        ],
        "question_id string, question string, plan string",
    )
    rows = {r["question_id"]: r for r in answer.answer_prompts(asked, points, cache, nodes, edges).collect()}
    tools = {"tool", "vector", "graph", "none"}
    assert {k: r["route"] for k, r in rows.items()} == {k: "tool" if k in tools else "retriever" for k in tools | {"find", "bad"}}
    outputs = {
        "tool": "Unknown tool requested.",
        "vector": "- Content: a volume stores data... [Source: b.txt, Page: 0]\n- Content: the scheduler places pods on nodes... [Source: a.txt, Page: 0]",
        "graph": '[{"source":"scheduler","rel":"RELATES_TO","target":"kubelet"}]',
        "none": fv.NO_CONNECTIONS,
    }
    for name, output in outputs.items():
        asked_text = {"tool": "what is 1+1", "vector": "stored data"}.get(name, "tell me")
        assert rows[name]["prompt"] == fv.ANSWER_PROMPT.format(label="tool output", content=output, question=asked_text)
    found = ["the scheduler places pods on nodes [Source: a.txt]", "a volume stores data [Source: b.txt]", "scheduler RELATES_TO kubelet"]
    assert rows["find"]["documents"] == found
    assert rows["find"]["prompt"] == fv.ANSWER_PROMPT.format(
        label="retrieved context", content="\n\n".join(found), question="scheduler places pods"
    )
    assert rows["tool"]["documents"] == [] and rows["bad"]["current_query"] == "a volume"
    assert rows["bad"]["documents"][0] == "a volume stores data [Source: b.txt]"

"""The corpus pipeline: what each stage keeps, on planted documents and on hard cases."""

import random
from collections import defaultdict

import brute
import corpus_pipeline
import pytest
from test_operators import prose

from stratadoc.llm.common import ready

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _score string, _id long"


def frame(spark, texts):
    return ready(spark).createDataFrame([(i, t, "en", "s", len(t or ""), "own", 7) for i, t in texts], COLUMNS)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    pick = random.Random(1)
    texts, labels = [], []
    for k in range(300):
        words = prose(5000 + k, 40 + k % 30).split()
        if k % 5 == 0:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), "wretchface")
        texts.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 5 == 0)))
    passage = prose(9000, 25)
    near = texts[1][1].split()
    near[20] = "otherword"
    texts += [
        (1000, texts[1][1]),
        (1001, " ".join(near)),
        (1002, prose(9001, 30) + " " + passage + " " + prose(9002, 30)),
        (1003, "write to a.b@mail.example.org or 10.0.0.1 " + prose(9003, 20)),
        (1004, None),
        (1005, ""),
        (1006, "short"),
        (1007, "twice " + prose(9004, 20)),
        (1007, "twice " + prose(9004, 20)),
        (None, prose(9005, 20)),
        (None, prose(9006, 30) + " " + passage),  # contaminated, without an id
        (1008, prose(9007, 40)),  # one id, different texts
        (1008, prose(9008, 40)),
        (1008, passage + " " + prose(9009, 30)),
        (1009, " ".join(prose(9010, 200).split()[k] + ("x" if k in (20, 60, 100, 140, 180) else "") for k in range(200))),
        (1010, prose(9010, 200)),  # above 0.8 by four words, below it by five
    ]
    frame(spark, texts).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts


def test_stages(spark, planted):
    root, texts = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == columns
        docs.write.parquet(f"{root}/after_{name}")
        docs = spark.read.parquet(f"{root}/after_{name}")
        kept[name] = {(r["doc_id"], r["text"]): r for r in docs.collect()}
        assert len(kept[name]) == docs.count() or name == "toxicity"  # equal rows stay until near copies go
    toxic = {(i, t) for i, t in texts if t and "wretchface" in t}
    assert set(kept["toxicity"]) == set(texts) - toxic
    left = [(i, t) for i, t in dict.fromkeys(texts) if (i, t) not in toxic]
    named = [d for d in left if d[0] is not None]
    component = brute.near_copies([(d, d[1]) for d in named], size=5)
    once = {(i, t) for i, t in left if i is None or component[i, t][1][0] == i}
    assert {(1008, t) for i, t in texts if i == 1008} <= once and {1009, 1010} <= {i for i, _ in once}
    assert brute.near_copies([d for d in left if d[0] in (1009, 1010)])[1010][1] == 1009
    assert set(kept["near_copies"]) == once and (1000, texts[1][1]) not in once
    assert set(kept["decontamination"]) == {(i, t) for i, t in once if prose(9000, 25) not in (t or "")}
    assert sum(i is None for i, _ in kept["decontamination"]) == 1
    rows = list(kept["personal_data"].values())
    assert len(rows) == len(once) - 3
    clean = {i: r for (i, _), r in kept["personal_data"].items()}
    assert clean[1003]["text"].startswith("write to [EMAIL] or [IP] ")
    assert clean[1003]["n_chars"] == len(clean[1003]["text"])
    assert all(r["text"] == t for (i, t) in once for r in [clean.get(i)] if r and i not in (1003, 1008, None))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, root).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    want = defaultdict(int)
    for r, ids in zip(rows, brute.encoded([r["text"] for r in rows], "word_bpe_49k.json")):
        want[r["doc_id"]] += len(ids)
    assert tokens == want


def test_run_gives_what_the_stages_give(spark, planted):
    root, _ = planted
    got = corpus_pipeline.run(spark, root)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{root}/after_personal_data"), root)
    pieces = lambda df: sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert pieces(got) == pieces(last)


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path)
    frame(spark, []).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0

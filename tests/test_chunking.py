"""Splitters: check values, edge cases and properties."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from plain import split_recursive
from pyspark.sql import functions as F

from stratadoc import fixed_values as fv
from stratadoc.operators import chunking


def split(text, size=512, overlap=50, separators=fv.SEPARATORS):
    return split_recursive(text, size, overlap, separators)


@pytest.mark.parametrize(
    "text,lengths",
    [("x" * 2000, [512, 512, 512, 512, 152]), ("x" * 513, [512, 51]), ("x" * 512, [512]), ("", []), (" \n\n \t ", [])],
)
def test_check_values(text, lengths):
    assert [len(c) for c in split(text)] == lengths


def test_blank_lines_split_first():
    text = "\n\n".join(w * 100 for w in "abcdefgh")
    chunks = split(text)
    assert all(len(c) <= 512 for c in chunks)
    assert chunks[0] == "\n\n".join(w * 100 for w in "abcde")


def test_overlap_is_carried():
    text = " ".join(f"w{i:03d}" for i in range(400))
    chunks = split(text)
    for one, two in zip(chunks, chunks[1:]):
        shared = max(n for n in range(60) if one.endswith(two[:n]))
        assert 0 < shared <= 50


def test_separators_are_a_setting():
    text = "a" * 300 + "." + "b" * 300
    assert split(text, separators=fv.SEPARATORS) == ["a" * 300, "." + "b" * 300]
    assert split(text, separators=fv.CONFIG_SEPARATORS)[0].startswith("a" * 300 + ".")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 40))
def test_chunks_fit_and_come_from_the_text(text, size):
    overlap = size // 4
    chunks = split(text, size, overlap)
    assert all(0 < len(c) <= size and c in text for c in chunks)
    # Nothing but white space is lost.
    covered = [False] * len(text)
    start = 0
    for c in chunks:
        at = text.find(c, max(0, start - size))
        covered[at : at + len(c)] = [True] * len(c)
        start = at + len(c)
    assert sum(len(c) for c in chunks) >= len("".join(text.split()))


SETTINGS = [(512, 50, fv.SEPARATORS), (512, 50, fv.CONFIG_SEPARATORS), (12, 3, fv.SEPARATORS), (7, 0, (" ", "")), (9, 8, ("ab", ".")), (20, 19, fv.SEPARATORS), (1, 0, ("",))]


@pytest.mark.parametrize("size,overlap,separators", SETTINGS)
def test_expression_equals_the_plain_splitter(spark, size, overlap, separators):
    rng = random.Random(size)
    texts = ["x" * 2000, "x" * 513, "x" * 512, "", " \n\n \t ", "\n\n".join(w * 100 for w in "abcdefgh"), "a" * 300 + "." + "b" * 300, "😀é\u2003" * 400, "$1 \\E (a|b) " * 90]
    texts += ["".join(rng.choices("abc  .\n😀\u2003", k=rng.randint(0, 120))) for _ in range(400)]
    texts += [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 900))) + rng.choice([".", "\n", ""]) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string").repartition(4)
    got = {r["i"]: r["c"] for r in df.select("i", chunking.recursive_chunks("text", size, overlap, separators).alias("c")).collect()}
    assert got.pop(len(texts)) is None
    assert all(got[i] == split(t, size, overlap, separators) for i, t in enumerate(texts))


def test_recursive_numbers_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    chunks = chunking.chunk(docs, chunking.recursive_chunks("text"))
    row = chunks.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m"), F.avg(F.length("text")).alias("a")).first()
    assert (row["n"], row["m"], round(row["a"], 1)) == (7249, 512, 336.1)


def test_fixed_windows(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc", k=n)) for n in (0, 1, 50, 51, 512, 513, 974, 975, 3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", chunking.fixed_windows("text"))
    for row in df.collect():
        t = row["text"]
        assert row["w"] == [w for w in (t[i : i + 512] for i in range(0, max(len(t) - 50, 1), 462)) if w]


def test_numbering_metadata_and_copies(spark):
    docs = spark.createDataFrame([(1, "f", "x" * 600), (2, "g", "y"), (3, "h", "y")], "doc_id long, filename string, text string")
    chunks = chunking.enrich(chunking.chunk(docs, chunking.recursive_chunks("text")))
    rows = {(r["doc_id"], r["chunk_index"]): r for r in chunks.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0), (3, 0)}
    assert rows[(1, 1)]["length"] == 138 and rows[(1, 1)]["filename"] == "f"
    assert rows[(2, 0)]["chunk_hash"] == hashlib.md5(b"y").hexdigest() and rows[(2, 0)]["ingested_at"]
    assert [r["doc_id"] for r in chunking.drop_copies(docs, "doc_id").orderBy("doc_id").collect()] == [1, 2]

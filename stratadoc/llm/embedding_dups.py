"""Near-duplicate vectors by random-hyperplane sign hashing with exact verification.

Equal vectors of a label are one class, with a stored number of its own, since an id may stand for several
vectors. In each of several tables a class has the signs of its products
with random hyperplanes as its key, together with label and dimension. Classes that share a key are
compared by cosine in double precision, as matrix products. A pair that also shares an earlier table's key
is counted there only, so nothing is counted twice and no pair leaves a task: a task gives each class its
number of links and one link of a spanning forest. Buckets above a block size are cut into blocks, and
every pair of blocks is a task, so that no bucket is capped.

The number of sign bits follows from the largest label, the number of tables from the wanted recall at
the threshold.

Defined results: a row with a null id, label or vector, or a vector that is empty, zero or holds null or
non-finite components, links with nothing and is kept; vectors of different dimensions are not compared;
rows with equal ids are vectors of their own, linked or not like any others; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratadoc.llm.common import narrow, ready
from stratadoc.llm.components import components
from stratadoc.session import durable

THRESHOLD = 0.93
#: Share of the pairs at the threshold that may share no table.
MISSES = 0.002
LEAST_BITS = 10
BLOCK_ROWS = 250
SEED = 20


def table_count(bits: int, threshold: float, misses: float = MISSES) -> int:
    """Tables after which a pair at the threshold is missed with a probability of ``misses`` at most."""
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(misses) / math.log1p(-share)))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sign_keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One row of keys per vector, one key per table."""
    planes = np.random.default_rng([SEED, units.shape[1]]).standard_normal((units.shape[1], bits * tables))
    signs = (units @ planes >= 0).reshape(len(units), tables, bits)
    return (signs << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            found = np.zeros((len(vectors), tables), np.uint64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                found[rows] = sign_keys(directions(np.array([vectors[r] for r in rows], np.float64)), bits, tables)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("cls", "n", "label", "embedding")],
                 pa.ListArray.from_arrays(offsets, pa.array(found.ravel().view(np.int64)))],
                names=["cls", "n", "label", "embedding", "signs"],
            )

    types = dict(classes.dtypes)
    return durable(
        classes.mapInArrow(keys, f"cls long, n long, label {types['label']}, embedding {types['embedding']}, signs array<long>")
    )


def _linked(units: np.ndarray, signs: np.ndarray, table: int, sides: np.ndarray, low: int, high: int, threshold: float):
    """Index pairs of one task that are links, and which of them no earlier table holds."""
    if low == high:
        left = right = np.arange(len(units))
    else:
        left, right = np.flatnonzero(sides == low), np.flatnonzero(sides == high)
    i, j = np.nonzero(units[left] @ units[right].T >= threshold)
    i, j = left[i], right[j]
    if low == high:
        i, j = i[i < j], j[i < j]
    earlier = (signs[i, :table] == signs[j, :table]).any(axis=1)
    return i, j, ~earlier


def _compare(threshold: float):
    """Contiguous groups of equal ``task`` to ``cls, links, root``."""

    def group(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
        classes = np.array([r["cls"] for r in rows], np.int64)
        weights = np.array([r["n"] for r in rows], np.int64)
        units = directions(np.array([r["embedding"] for r in rows], np.float64))
        signs = np.array([r["signs"] for r in rows], np.int64)
        one = rows[0]
        sides = np.array([r["side"] for r in rows], np.int64)
        i, j, new = _linked(units, signs, one["table"], sides, one["low"], one["high"], threshold)
        if len(i) == 0:
            return
        links = np.bincount(i[new], weights[j[new]], len(rows)) + np.bincount(j[new], weights[i[new]], len(rows))
        root = classes.copy()
        while True:  # smallest class along links
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            if (root == before).all():
                break
        for k in np.unique(np.concatenate([i, j])).tolist():
            yield int(classes[k]), int(links[k]), int(root[k])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            return pa.RecordBatch.from_arrays(columns, names=["cls", "links", "root"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held and held[-1]["task"] != row["task"]:
                    found += group(held)
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out(list(group(held)))

    return compare


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, misses: float = MISSES,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    ready(vectors.sparkSession)
    rows = narrow(vectors, vec_id=vec_id, embedding=embedding, label=label)
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    grouped = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = durable(grouped.withColumn("cls", F.monotonically_increasing_id()))
    largest = rows.where("sound").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(LEAST_BITS, math.ceil(math.log2(largest)))
    tables = table_count(bits, threshold, misses)
    keyed = _keyed(classes.drop("rep"), bits, tables)

    entries = keyed.select("cls", "label", F.size("embedding").alias("dim"), F.posexplode("signs").alias("table", "sign"))
    entries = entries.select("cls", "table", F.xxhash64("label", "dim", "table", "sign").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    filed = entries.join(buckets, "key")
    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    dealt = filed.select("cls", "table", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("side"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    dealt = dealt.select("cls", "table", "side", low.alias("low"), high.alias("high"), F.xxhash64("key", low, high).alias("task"))
    tasks = dealt.join(keyed.select("cls", "n", "embedding", "signs"), "cls")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "cls")
    found = durable(tasks.mapInArrow(_compare(threshold), "cls long, links long, root long"))

    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    placed = classes.join(counted, "cls", "left").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # Named by the smallest id of all its classes.
    names = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(names, "component").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    sound_rows = rows.where("sound").select("vec_id", "label", "embedding").join(of_class, ["label", "embedding"])
    other = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = sound_rows.select("vec_id", "n_links", "component_id").unionByName(other)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

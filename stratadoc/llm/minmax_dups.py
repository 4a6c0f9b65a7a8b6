"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct shingles of four words. Each of 64 permutations gives two signature
values, the smallest and the largest permuted hash; 128 values make 32 bands of four. At a similarity of
0.8 a pair misses every band with a probability below 1e-7. Documents with equal sets are one class, with a
stored number of its own, and only classes are banded. Links are confirmed on the full shingle sets, in
two steps, since classes that already hang together need no comparison:

1. every member of a band bucket with the bucket's smallest one;
2. in buckets whose members still belong to different components, all pairs of different components whose
   sizes allow the similarity, each pair in the first bucket that it shares.

Step 2 deals the members of a bucket's largest component and those outside it into blocks; only the few
outside meet every block. A first pass over numbers and bands finds which members of a task have a pair
there at all, and only their sets are sent. Sets are compared as bits, and only links that join components
leave a task.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; rows with the same id are documents of their own, linked or not like any others; a
row without an id is linked with nothing, its component is null and it is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.llm.common import narrow, ready, slices, text_bytes
from stratadoc.llm.components import components
from stratadoc.llm.wordhash import gram_hashes, mix, words
from stratadoc.session import durable

SHINGLE_WORDS = 4
PERCENT = 80
PERMUTATIONS = 64
BANDS = 32
BLOCK_ROWS = 500
BLOCK_SHINGLES = 1_000_000
#: Shingles that are compared at a time.
COLUMNS = 1 << 14
SLICE_BYTES = 4 << 20

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Odd multipliers; multiplication by one of them permutes the 64-bit hashes.
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``rows, hashes`` of the distinct shingles of each text, sorted by row and hash."""
    w = words(*text_bytes(column), WORD_BYTES)
    hashes, valid = gram_hashes(w, size)
    rows, found = [w.row[valid]], [hashes[valid]]
    counts = np.diff(w.first)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            found.append(gram_hashes(w, n)[0][w.first[short]])
    row, value = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signature(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set its band keys; ``starts`` are the first places of the sets in ``values``."""
    low = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    high = np.empty_like(low)
    for p, factor in enumerate(_FACTORS):
        moved = values * factor
        low[p] = np.minimum.reduceat(moved, starts)
        high[p] = np.maximum.reduceat(moved, starts)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        own = (low[b], low[b + BANDS], high[(b + 11) % PERMUTATIONS], high[(b + 43) % PERMUTATIONS])
        key = np.full(len(starts), b + 1, np.uint64)
        for values_of_row in own:
            key = mix(key ^ values_of_row) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, b] = key
    return keys


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, of, n_shingles, set_a, set_b, bands`` of ``(doc_id, of, text)``, without the texts. Stored."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                row, value = shingle_sets(batch.column("text"), size)
                counts = np.bincount(row, minlength=batch.num_rows)
                full = np.flatnonzero(counts)
                sums = np.zeros((2, batch.num_rows), np.uint64)
                bands = np.zeros((batch.num_rows, BANDS), np.uint64)
                if len(full):
                    starts = (np.cumsum(counts) - counts)[full]
                    sums[0, full] = np.add.reduceat(value, starts)
                    sums[1, full] = np.add.reduceat(mix(value), starts)
                    bands[full] = signature(value, starts)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("of"),
                        pa.array(counts),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].ravel().view(np.int64))),
                    ],
                    names=["doc_id", "of", "n_shingles", "set_a", "set_b", "bands"],
                )

    schema = "doc_id long, of long, n_shingles long, set_a long, set_b long, bands array<long>"
    return durable(docs.mapInArrow(sign, schema))


class Texts:
    """Texts of classes: every class names the row that stands for it by id and hash of the text."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int):
        self.docs, self.size = docs, size
        self.places = classes.select("cls", "doc_id", "of")

    def _of(self, numbers: DataFrame, cls: str, suffix: str = "") -> DataFrame:
        """``numbers`` with the text of the class ``cls``."""
        placed = numbers.join(self.places.select(F.col("cls").alias(cls), F.col("doc_id").alias("_id"), F.col("of").alias("_of")), cls)
        texts = self.docs.select(F.col("doc_id").alias("_id"), F.col("of").alias("_of"), F.col("text").alias(f"text{suffix}"))
        return placed.join(texts, ["_id", "_of"]).drop("_id", "_of")

    def confirmed(self, pairs: DataFrame, percent: int) -> DataFrame:
        """Pairs ``a, b`` whose full shingle sets are similar enough. Stored."""
        size = self.size

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text_a", SLICE_BYTES):
                    sides = [shingle_sets(batch.column(c), size) for c in ("text_a", "text_b")]
                    sizes = [np.bincount(row, minlength=batch.num_rows) for row, _ in sides]
                    # The row goes into the hash, so one sorted search serves all pairs of the batch.
                    keys = [mix(value + mix(row.astype(np.uint64) + np.uint64(1))) for row, value in sides]
                    other = np.sort(keys[1])
                    at = np.minimum(np.searchsorted(other, keys[0]), max(len(other) - 1, 0))
                    common = other[at] == keys[0] if len(other) else np.zeros(len(keys[0]), bool)
                    shared = np.bincount(sides[0][0][common], minlength=batch.num_rows)
                    linked = (shared > 0) & (100 * shared >= percent * (sizes[0] + sizes[1] - shared))
                    yield batch.select(["a", "b"]).filter(pa.array(linked))

        both = self._of(self._of(pairs, "a", "_a"), "b", "_b").select("a", "b", "text_a", "text_b")
        return durable(both.mapInArrow(compare, "a long, b long"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``cls, hashes`` of the wanted classes: all shingles, in order. Stored."""
        size = self.size

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE_BYTES):
                    row, value = shingle_sets(batch.column("text"), size)
                    ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
                    sets = [value[x:y].tobytes() for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], names=["cls", "hashes"])

        return durable(self._of(wanted, "cls").select("cls", "text").mapInArrow(collect, "cls long, hashes binary"))


def shared_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values the sets ``x[k]`` and ``y[k]`` have in common; ``x`` ascends."""
    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = place[: len(x)], place[len(x) :]
    value = np.concatenate([sets[u] for u in used])
    row = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    order = np.argsort(value)
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    # A value of one set alone is in no pair.
    several = np.bincount(column) > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    total = int(several.sum())
    width = min(COLUMNS, -(-total // 64) * 64)
    limits = np.flatnonzero(np.diff(x, prepend=-1, append=len(used)))
    out = np.zeros(len(x), np.int64)
    for first in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        bits = np.zeros((len(used), width), bool)
        bits[row[a:b], column[a:b] - first] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for c, d in zip(limits[:-1].tolist(), limits[1:].tolist()):
            out[c:d] += np.bitwise_count(packed[x[c]] & packed[y[c:d]]).sum(axis=1, dtype=np.int64)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], each, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``each`` over contiguous rows of equal ``task``, given as a table; it returns columns of ``schema``."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        found = each(pa.Table.from_batches(held).combine_chunks())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        task = batch.column("task").to_numpy()
        limits = np.flatnonzero(np.diff(task, prepend=task[:1], append=task[-1:])).tolist()
        for first, last in zip([0, *limits], [*limits, len(task)]):
            if held and held[-1].column("task")[0].as_py() != task[first]:
                yield close()
            held.append(batch.slice(first, last - first))
    if held:
        yield close()


def _pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one task that have to be compared: other component, fitting size, first bucket that both share.

    Rows are on the left or right side of the task, or on both where a block meets itself.
    """
    cls, component, n, left, right = (table.column(c).to_numpy() for c in ("cls", "component", "n", "left", "right"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    band = table.column("band")[0].as_py()
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    a, b = n[x][:, None], n[y][None, :]
    fits = (component[x][:, None] != component[y][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    i, j = np.nonzero(fits)
    i, j = x[i], y[j]
    # A block that meets itself has every pair twice.
    once = ~(right[i] & left[j]) | (cls[i] < cls[j])
    i, j = i[once], j[once]
    keep = np.zeros(len(i), bool)
    for first in range(0, len(i), COLUMNS):
        part = slice(first, first + COLUMNS)
        keep[part] = (bands[i[part]] == bands[j[part]]).argmax(axis=1) == band
    return i[keep], j[keep]


def _needed(percent: int):
    """Rows that have a pair in their task."""
    schema = pa.schema([("task", pa.int64()), ("cls", pa.int64())])

    def each(table: pa.Table) -> tuple:
        used = np.unique(np.concatenate(_pairs(table, percent)))
        return table.column("task").to_numpy()[used], table.column("cls").to_numpy()[used]

    return lambda batches: _grouped(batches, each, schema)


def _joining(percent: int):
    """Links between different components of a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(table: pa.Table) -> tuple:
        i, j = _pairs(table, percent)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        out: list[tuple[int, int]] = []
        if len(i):
            sets = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
            own = np.array([len(h) for h in sets])
            shared = shared_counts(sets, i, j)
            linked = 100 * shared >= percent * (own[i] + own[j] - shared)
            cls, component = table.column("cls").to_pylist(), table.column("component").to_pylist()
            label = {c: c for c in component}

            def root(c: int) -> int:
                while label[c] != c:
                    label[c] = c = label[label[c]]
                return c

            for x, y in zip(i[linked].tolist(), j[linked].tolist()):
                p, q = root(component[x]), root(component[y])
                if p != q:
                    label[max(p, q)] = min(p, q)
                    out.append((cls[x], cls[y]))
        return tuple(zip(*out)) if out else ([], [])

    return lambda batches: _grouped(batches, each, schema)


def _merged(state: DataFrame, links: DataFrame) -> DataFrame:
    """``cls, n, component`` after ``links`` between classes. Stored."""
    of = state.select(F.col("cls").alias("a"), F.col("component").alias("ca"))
    to = state.select(F.col("cls").alias("b"), F.col("component").alias("cb"))
    edges = links.join(of, "a").join(to, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))
    joined = state.join(roots, "component", "left")
    return durable(joined.select("cls", "n", F.coalesce("root", "component").alias("component")))


def _mixed(filed: DataFrame, state: DataFrame) -> DataFrame:
    """Members of buckets with several components, and whether they are in the bucket's largest one (``inside``).

    In a bucket of two, step 1 has compared the only pair.
    """
    labelled = filed.select("key", "band", "cls", "n").join(state.select("cls", "component"), "cls")
    # One row per bucket and component.
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("size").alias("size"))
    wanted = largest.where("parts > 1 and size > 2").select("key", "largest")
    return labelled.join(wanted, "key").withColumn("inside", F.col("component") == F.col("largest")).drop("largest")


def _joining_links(mixed: DataFrame, reps: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """Links between components of mixed buckets. Stored."""
    mixed = durable(mixed)

    def blocks(side: str) -> Column:
        size, shingles = F.count_if(F.expr(side)), F.sum(F.when(F.expr(side), F.col("n")).otherwise(0))
        return F.greatest(F.lit(1), F.ceil(size / F.lit(BLOCK_ROWS)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")

    cut = mixed.groupBy("key").agg(blocks("inside").alias("ins"), blocks("not inside").alias("outs"))
    # Blocks 0 .. outs - 1 hold the members outside, the rest those inside. Those inside meet no one but those outside.
    outside = F.col("outs")
    own = F.when(F.col("inside"), outside + F.pmod(F.xxhash64("cls"), F.col("ins"))).otherwise(F.pmod(F.xxhash64("cls"), outside))
    last = F.when(F.col("inside"), outside - 1).otherwise(outside + F.col("ins") - 1)
    dealt = mixed.join(cut, "key").withColumns({"own": own.cast("int"), "other": F.explode(F.sequence(F.lit(0), last.cast("int")))})
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tasks = dealt.select(
        F.xxhash64("key", low, high).alias("task"), "band", "cls", "n", "component",
        (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"),
    )
    banded = tasks.join(reps.select("cls", "bands"), "cls").repartition("task").sortWithinPartitions("task", "cls")
    needed = durable(banded.mapInArrow(_needed(percent), "task long, cls long"))
    sets = texts.sets(needed.select("cls").distinct())
    full = tasks.join(needed, ["task", "cls"]).join(reps.select("cls", "bands"), "cls").join(sets, "cls")
    return durable(full.repartition("task").sortWithinPartitions("task", "cls").mapInArrow(_joining(percent), "a long, b long"))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    return judged_rows(narrow(docs, doc_id=doc_id, text=text), percent, shingle_words).drop("of", "stays")


def judged_rows(docs: DataFrame, percent: int, shingle_words: int) -> DataFrame:
    """Result per row of ``(doc_id, text)``, with the hash ``of`` of its text.

    ``stays`` marks one row of each component by id and hash, or several that agree in id and text; rows that
    are linked with nothing stay.
    """
    ready(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("of"), "text")
    signed = signatures(docs, shingle_words)
    has = signed.where("n_shingles > 0 and doc_id is not null")
    sets = ["set_a", "set_b", "n_shingles"]
    grouped = has.groupBy(*sets).agg(F.min(F.struct("doc_id", "of")).alias("first"))
    numbered = grouped.select(*sets, F.col("first.doc_id").alias("doc_id"), F.col("first.of").alias("of"))
    classes = durable(numbered.withColumn("cls", F.monotonically_increasing_id()))
    own = has.select("doc_id", "of", "bands", *sets)
    # Rows that agree in id and text are equal.
    reps = own.join(classes, [*sets, "doc_id", "of"]).select("cls", F.col("n_shingles").alias("n"), "bands")
    reps = durable(reps.dropDuplicates(["cls"]))
    again = has.groupBy("doc_id", "of").count().where("count > 1").limit(1)
    texts = Texts(docs if again.isEmpty() else docs.dropDuplicates(["doc_id", "of"]), classes, shingle_words)

    entries = reps.select(F.posexplode("bands").alias("band", "key"), "cls", "n")
    buckets = entries.groupBy("key").agg(F.min_by(F.struct("cls", "n"), "cls").alias("first"), F.max("cls").alias("high"))
    buckets = buckets.where("first.cls < high").select("key", F.col("first.cls").alias("low"), F.col("first.n").alias("n_low"))
    filed = durable(entries.join(buckets, "key"))
    fits = f"100 * least(n, n_low) >= {percent} * greatest(n, n_low)"
    stars = durable(filed.where("low < cls").where(fits).select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct())
    state = _merged(reps.select("cls", "n", F.col("cls").alias("component")), texts.confirmed(stars, percent))
    more = _joining_links(_mixed(filed, state), reps, texts, percent)
    if not more.isEmpty():
        state = _merged(state, more)

    # A component is named by the smallest id of its classes.
    placed = classes.select(*sets, "doc_id", "of", "cls").join(state.select("cls", "component"), "cls")
    names = placed.groupBy("component").agg(F.min(F.struct("doc_id", "of")).alias("least"))
    of_class = placed.join(names, "component").select(*sets, "least")
    linked = has.select("doc_id", "of", *sets).join(of_class, sets)
    linked = linked.select("doc_id", "of", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "of") == F.col("least")).alias("stays"))
    alone = signed.where("n_shingles = 0 or doc_id is null")
    alone = alone.select("doc_id", "of", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

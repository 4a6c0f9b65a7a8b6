"""Benchmark decontamination by winnowing.

Both sides keep, for every ten consecutive words, the smallest hash of the five-word grams in them. Any
ten words that a document shares with an item therefore share a kept fingerprint. Document fingerprints
that the benchmark holds too are extended to all windows around them; those windows meet the benchmark's
windows in an equality join on their text, so a hash collision cannot make a hit.

Defined results: a null or wordless text has no words and no hits; an item without words has no window;
an item shorter than a window is one window of its own length; null item ids count as no item; rows with
equal ids are judged on their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stratadoc.llm.common import narrow, ready, slices, text_bytes
from stratadoc.llm.wordhash import Words, gram_hashes, words
from stratadoc.session import durable

WINDOW = 10
GRAM = 5
#: Hashes of benchmark windows and fingerprints that a task holds at a time, 8 bytes each.
BLOCK_HASHES = 8_000_000
SLICE_BYTES = 4 << 20

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = True
WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True


def winnow(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept grams: the smallest of each window, the last one if several are."""
    grams, _ = gram_hashes(w, gram)
    width = window - gram + 1
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = w.row[:n] == w.row[window - 1 :]
    best, place = grams[width - 1 : width - 1 + n].copy(), np.full(n, width - 1)
    for k in range(width - 2, -1, -1):
        less = grams[k : k + n] < best
        best[less], place[less] = grams[k : k + n][less], k
    kept = np.unique((np.arange(n) + place)[whole])
    return kept, grams[kept]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``item_id, text, words, hash, fingerprint`` for every window of every item ``(item_id, text)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(*text_bytes(batch.column("text")), WORD_BYTES)
            out: list[dict] = []
            hashes = {n: gram_hashes(w, n)[0] for n in range(1, window + 1)}
            grams = gram_hashes(w, gram)[0]
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                a, b = int(w.first[row]), int(w.first[row + 1])
                n = min(window, b - a)
                for s in range(a, b - n + 1 if n else a):
                    # Of a shorter item, all words are the fingerprint.
                    kept = grams[s : s + window - gram + 1].min() if n == window else hashes[n][s]
                    out.append(
                        {
                            "item_id": item, "text": w.text(s, s + n).decode(), "words": n,
                            "hash": int(hashes[n][s].view(np.int64)), "fingerprint": int(kept.view(np.int64)),
                        }
                    )
            yield pa.RecordBatch.from_pylist(
                out,
                schema=pa.schema(
                    [("item_id", pa.int64()), ("text", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("fingerprint", pa.int64())]
                ),
            )

    schema = "item_id long, text string, words int, hash long, fingerprint long"
    return durable(benchmark.where("item_id is not null").mapInArrow(cut, schema))


def candidate_windows(docs: DataFrame, tables: dict[int, tuple[np.ndarray, np.ndarray]], window: int, gram: int) -> DataFrame:
    """``row, doc_id, n_words, candidates`` per document; candidates are windows whose hashes match.

    ``tables``: by number of words, the sorted fingerprints and window hashes of one benchmark block.
    """

    def scan(w: Words) -> Iterator[tuple[int, np.ndarray]]:
        for size, (fingerprints, hashes) in tables.items():
            all_hashes, valid = gram_hashes(w, size)
            if size < window:
                yield size, np.flatnonzero(valid & _member(all_hashes, hashes))
                continue
            places, kept = winnow(w, window, gram)
            places = places[_member(kept, fingerprints)]
            # Extend each hit to the windows that contain it.
            starts = np.unique(places[:, None] - np.arange(window - gram + 1)[None, :])
            starts = starts[starts >= 0]
            starts = starts[valid[starts]]
            yield size, starts[_member(all_hashes[starts], hashes)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 33, 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32()), ("text", pa.string())]))
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                w = words(*text_bytes(batch.column("text")), WORD_BYTES)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for size, starts in scan(w):
                    for s in starts.tolist():
                        row = int(w.row[s])
                        text = w.text(s, s + size).decode()
                        found[row].append({"start": s - int(w.first[row]), "words": size, "text": text})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part + number + np.arange(batch.num_rows)),
                        batch.column("doc_id"),
                        pa.array(np.diff(w.first)),
                        pa.array(found, kind),
                    ],
                    names=["row", "doc_id", "n_words", "candidates"],
                )
                number += batch.num_rows

    schema = "row long, doc_id long, n_words long, candidates array<struct<start:long,words:int,text:string>>"
    # Stored, since the row numbers come from the tasks and two joins read them.
    return durable(docs.mapInArrow(find, schema))


def _blocks(windows: DataFrame, block_hashes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Hash tables of the benchmark, in blocks of bounded size."""
    rows = windows.select("words", "hash", "fingerprint").distinct()
    blocks = max(1, -(-2 * rows.count() // block_hashes))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == block).toArrow()
        sizes = part.column("words").to_numpy()
        columns = [part.column(c).to_numpy().view(np.uint64) for c in ("fingerprint", "hash")]
        yield {int(n): tuple(np.unique(c[sizes == n]) for c in columns) for n in np.unique(sizes)}


def covered_words(places: Column) -> Column:
    """Words covered by ``array<struct<start, words>>`` sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, place: Column) -> Column:
        end = F.greatest(state["end"], place["start"] + place["words"])
        return F.struct((state["n"] + end - F.greatest(state["end"], place["start"])).alias("n"), end.alias("end"))

    return F.aggregate(places, zero, add, lambda state: state["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_hashes: int = BLOCK_HASHES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document the words that stand in a benchmark window, and the items whose windows occur."""
    ready(docs.sparkSession)
    docs = narrow(docs, doc_id=doc_id, text=text)
    windows = benchmark_windows(narrow(benchmark, item_id="item_id", text="text"), window, gram)
    found = [candidate_windows(docs, tables, window, gram) for tables in _blocks(windows, block_hashes)]
    places = found[0].select("row", F.explode("candidates").alias("c"))
    for more in found[1:]:
        places = places.unionByName(more.select("row", F.explode("candidates").alias("c")))
    places = places.select("row", "c.start", "c.words", "c.text")
    hits = places.join(windows.select("text").distinct(), "text", "left_semi")
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "words"))).alias("spans"))
    # Copies of a window within one document meet the items once.
    items = hits.select("row", "text").distinct().join(windows.select("text", "item_id").distinct(), "text")
    names = items.select("row", F.col("item_id").cast("string").alias("item")).distinct()
    lists = names.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    joined = found[0].select("row", "doc_id", "n_words").join(spans, "row", "left").join(lists, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(covered_words(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.col("spans").alias("spans"),
    )


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns of :func:`contamination`."""
    return contamination(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

"""Token files: whole documents as ids, compressed by a Re-Pair grammar per shard.

A shard is one row: its documents in order and one binary value. Within a shard, pairs of symbols that
occur often are replaced by nonterminals until none is left, never across documents. The rules and the
length that each expands to are stored, so a slice of a document is decoded without its other parts.

Binary value, little-endian, all arrays after a header of eight 64-bit integers
(magic, vocabulary, documents, rules, symbols, width of a symbol, 0, 0):
doc ids (i8), null marks of doc ids (u1), symbols per document (i8), ids per document (i8),
left and right side of the rules (u4 each), expansion lengths of the rules (u4), symbols (u2 or u4).

Defined results: a null text is empty, so its document holds the end id alone; rows with equal or null
ids are separate documents, null ids first; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratadoc.llm.common import narrow, ready, slices
from stratadoc.llm.tokens import process_encoder
from stratadoc.session import shared_folder

MAGIC = 0x52455041
SHARD_IDS = 1 << 20
#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 4 << 20
SHARD_SCHEMA = "part int, seq int, n_docs long, n_ids long, data binary"
DOCUMENT_SCHEMA = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _kinds(first: np.ndarray, second: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, how often each occurs, and the places of all pairs in that order."""
    first = first.astype(np.int64)
    bits, low = symbols.bit_length(), len(first).bit_length()
    if 2 * bits + low <= 63:
        # Pair and place in one number sort several times faster than places by their pairs.
        packed = first
        packed <<= bits
        packed |= second
        packed <<= low
        packed |= np.arange(len(first))
        packed.sort()
        order = packed & ((1 << low) - 1)
        packed >>= low
    else:
        bits = 32
        packed = (first << bits) | second
        order = np.argsort(packed)
        packed = packed[order]
    opened = np.ones(len(first), bool)
    opened[1:] = packed[1:] != packed[:-1]
    firsts = np.flatnonzero(opened)
    kinds = packed[firsts]
    return (kinds >> bits << 32) | kinds & ((1 << bits) - 1), np.diff(firsts, append=len(first)), order


def _alternate(at: np.ndarray, after: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Truth values: every second place within runs of one symbol, whose pairs overlap, is false."""
    out = np.ones(len(at), bool)
    alike = np.flatnonzero(kind[1:] == kind[:-1])
    same = alike[after[at[alike]] == at[alike + 1]] + 1
    # Distance to the place before the stretch of such places that each belongs to.
    opens = np.diff(same, prepend=-1) != 1
    distance = same - np.maximum.accumulate(np.where(opens, same, 0)) + 1
    out[same[distance % 2 == 1]] = False
    return out


def repair(ids: np.ndarray, lengths: np.ndarray, vocabulary: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``left, right`` sides of the rules, the symbols, and the number of symbols of each document.

    Rounds go on until no pair occurs ``least`` times. A round replaces all pairs that do; where they overlap, the more frequent one is taken. What is left for the next round are places
    beside a replaced one and places that were frequent but gave way. Every symbol keeps its first place,
    and ``after`` and ``before`` lead to its neighbours in the document.
    """
    n = len(ids)
    # Four bytes each, so that most of what a round looks up stays in a core's cache.
    symbols = np.append(ids.astype(np.int32), np.int32(-1))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    full = lengths[lengths > 0]
    ends = np.cumsum(full)
    after[ends - 1] = after[n] = before[ends - full] = n
    gone, marked, strength = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int32)
    left, right, total = [], [], vocabulary
    known, rules = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, whole = np.flatnonzero(after[:n] < n), True
    while True:
        kinds, counts, order = _kinds(symbols[at], symbols[after[at]], total)
        old = np.full(len(kinds), -1)
        if len(known) and len(kinds):
            place = np.minimum(np.searchsorted(kinds, known), len(kinds) - 1)
            again = kinds[place] == known
            old[place[again]] = rules[again]
        frequent = (counts >= least) | (old >= 0)
        if not frequent.any():
            if whole:
                break
            # A rule that is used again may have added to pairs that were rare before, so all are counted.
            at, whole = np.flatnonzero((after[:n] < n) & ~gone[:n]), True
            continue
        chosen = order[np.repeat(frequent, counts)]
        kinds, counts, old = kinds[frequent], counts[frequent], old[frequent]
        kind = np.full(len(at), -1)
        kind[chosen] = np.repeat(np.arange(len(kinds)), counts)
        chosen = kind >= 0
        at, kind = at[chosen], kind[chosen]
        single = _alternate(at, after, kind)
        # Different for different pairs, so that of two that overlap one is always the stronger.
        spread = (np.arange(len(kinds), dtype=np.int64) * 0x9E3779B1) & 0xFFFFFFFF
        rank = np.empty(len(kinds), np.int32)
        rank[np.argsort((counts << 32) | spread)] = np.arange(1, len(kinds) + 1, dtype=np.int32)
        taken, open_ = [], np.flatnonzero(single)
        own, value = at[open_], rank[kind[open_]]
        strength[own] = value
        back, next_ = before[own], after[own]
        while len(open_):
            won = np.flatnonzero((value > strength[back]) & (value > strength[next_]))
            taken.append(open_[won])
            strength[back[won]] = strength[next_[won]] = strength[own[won]] = 0
            stay = np.flatnonzero(strength[own])
            open_, own, value, back, next_ = open_[stay], own[stay], value[stay], back[stay], next_[stay]
        strength[at] = strength[n] = 0
        taken = np.concatenate(taken)
        # Half of the places of a symbol's pair with itself may overlap.
        need = np.where(kinds >> 32 == kinds & 0xFFFFFFFF, (least + 1) // 2, least)
        used = (np.bincount(kind[taken], minlength=len(kinds)) >= need) | (old >= 0)
        fresh = np.flatnonzero(used & (old < 0))
        old[fresh] = total + np.arange(len(fresh))
        left.append(kinds[fresh] >> 32)
        right.append(kinds[fresh] & 0xFFFFFFFF)
        total += len(fresh)
        known, rules = np.concatenate([known, kinds[fresh]]), np.concatenate([rules, old[fresh]])
        by_pair = np.argsort(known)
        known, rules = known[by_pair], rules[by_pair]
        taken = taken[used[kind[taken]]]
        start = at[taken]
        second = after[start]
        third = after[second]
        symbols[start], after[start], before[third], gone[second] = old[kind[taken]], third, start, True
        marked[at] = marked[start] = marked[before[start]] = True
        touched = np.flatnonzero(marked[:n])
        marked[touched] = marked[n] = False
        at, whole = touched[(after[touched] < n) & ~gone[touched]], False
    stay = np.flatnonzero(~gone[:n])
    first = np.zeros(n + 1, bool)
    first[ends - full] = True
    sizes = np.zeros(len(lengths), np.int64)
    sizes[lengths > 0] = np.diff(np.flatnonzero(first[stay]), append=len(stay))
    join = lambda parts: np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
    return join(left), join(right), symbols[stay].astype(np.int64), sizes


def expansion_lengths(left: np.ndarray, right: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids that each rule stands for. A rule refers to earlier rules only."""
    out = np.zeros(vocabulary + len(left), np.int64)
    out[:vocabulary] = 1
    rest = np.arange(len(left))
    while len(rest):
        # The first rule left is known now, and with it all rules of its round.
        a, b = out[left[rest]], out[right[rest]]
        sound = (a > 0) & (b > 0)
        out[vocabulary + rest[sound]] = (a + b)[sound]
        rest = rest[~sound]
    return out[vocabulary:].astype(np.uint32)


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """The binary value of a shard."""
    left, right, symbols, sizes = repair(ids, lengths, vocabulary)
    width = 2 if vocabulary + len(left) <= 1 << 16 else 4
    header = np.array([MAGIC, vocabulary, len(doc_ids), len(left), len(symbols), width, 0, 0], "<i8")
    parts = [
        header,
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        sizes.astype("<i8"),
        lengths.astype("<i8"),
        left.astype("<u4"),
        right.astype("<u4"),
        expansion_lengths(left, right, vocabulary).astype("<u4"),
        symbols.astype(f"<u{width}"),
    ]
    return b"".join(p.tobytes() for p in parts)


class TokenShard:
    """A shard read back: whole documents or slices of them."""

    def __init__(self, data: bytes) -> None:
        magic, self.vocabulary, docs, rules, symbols, width, _, _ = np.frombuffer(data, "<i8", 8).tolist()
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 64

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else d for d, n in zip(ids.tolist(), null.tolist())]
        self.sizes, self.lengths = take("<i8", docs), take("<i8", docs)
        self.left, self.right, self.spans = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _expand(self, symbols: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of what the symbols stand for; parts outside are not expanded."""
        symbols = symbols.astype(np.int64)
        span = self._spans(symbols)
        at = np.cumsum(span) - span
        part = start > 0 or stop is not None
        stop = int(span.sum()) if stop is None else stop
        out = np.empty(max(stop - start, 0), np.uint32)
        while len(symbols):
            if part:
                inside = (at < stop) & (at + span > start)
                if not inside.all():
                    symbols, at = symbols[inside], at[inside]
            rule = symbols >= self.vocabulary
            plain, rule = np.flatnonzero(~rule), np.flatnonzero(rule)
            out[at[plain] - start] = symbols[plain]
            number, at = symbols[rule] - self.vocabulary, at[rule]
            left = self.left[number].astype(np.int64)
            size = self._spans(left)
            symbols, at = np.concatenate([left, self.right[number].astype(np.int64)]), np.concatenate([at, at + size])
            if part:
                span = np.concatenate([size, self.spans[number].astype(np.int64) - size])
        return out

    def _spans(self, symbols: np.ndarray) -> np.ndarray:
        """Number of ids that each symbol stands for."""
        out = np.ones(len(symbols), np.int64)
        rule = np.flatnonzero(symbols >= self.vocabulary)
        out[rule] = self.spans[symbols[rule] - self.vocabulary]
        return out

    def all_ids(self) -> np.ndarray:
        """Ids of all documents, one after the other."""
        return self._expand(self.symbols)

    def slice(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document; only what reaches into the slice is expanded."""
        own = self.symbols[self.starts[document] : self.starts[document] + self.sizes[document]]
        ends = np.cumsum(self._spans(own))
        stop = min(stop, int(self.lengths[document]))
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return self._expand(own[lo:hi], start - skipped, stop - skipped)


def token_shards(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of documents ``(doc_id, text)`` in ascending order of ``doc_id``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_encoder(tokenizer, "lead")
        part = TaskContext.get().partitionId()
        seq, held, names = 0, [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held])
            lengths = np.concatenate([x for _, x in held])
            data = pack_shard(names, ids, lengths, vocabulary)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_docs": len(names), "n_ids": len(ids), "data": data}],
                schema=pa.schema(
                    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
                ),
            )

        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                held.append(encoder.encode(batch.column("text"), end_id))
                names += batch.column("doc_id").to_pylist()
                if sum(len(x) for x, _ in held) >= shard_ids:
                    yield close()
                    seq, held, names = seq + 1, [], []
        if names:
            yield close()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(shards, SHARD_SCHEMA)


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from stored shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in ("part", "seq", "data")}
                shard = TokenShard(one["data"])
                ids = shard.all_ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, one["part"], np.int32)),
                        pa.array(np.full(n, one["seq"], np.int32)),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts),
                        pa.array(shard.lengths.astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "seq", "data").mapInArrow(decode, DOCUMENT_SCHEMA)
    # Ids before a shard: those of earlier parts, of which there is one row per task, and of its own part.
    own = shards.select("part", "seq", "n_ids")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumn("in_part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    sums = own.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("part_ids").over(ahead), F.lit(0)).alias("ahead"))
    offsets = inside.join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("ahead")).alias("shard_start"))
    return found.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write the token files of documents and return the stored shards as a table."""
    spark = ready(docs.sparkSession)
    shards = token_shards(docs, tokenizer, end_id, vocabulary)
    shards.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257, path: str | None = None) -> DataFrame:
    """Encode and store whole documents, then describe each one as read back from the files."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    return read_documents(write_tokens(narrow(docs, doc_id="doc_id", text="text"), path, tokenizer, end_id, vocabulary))

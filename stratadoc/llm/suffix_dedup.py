"""Removal of repeated byte strings, by longest previous factors.

Every byte that is covered by a string of 50 bytes that also starts in a document with a smaller id goes;
the first copy stays. No task ever holds the suffixes of the whole corpus:

1. Texts are kept as chunks, one row each. Every 50-byte string has an anchor, the smallest hash of its
   24-byte grams, so equal strings have equal anchors. Runs of strings with the same anchor are segments.
2. Chunks send the distinct anchors, packed and by hash bucket; each bucket answers which of them occur in
   several chunks. Segments whose anchor occurs in one document only cannot repeat and drop out.
3. Chunks send their other segments, each distinct one once with its smallest document id. Within a
   bucket, distinct segments stand in order of that id. Their suffix order, cut at 50 bytes, comes from
   doubling ranks of 8, 16, 32 and 50 bytes. Scans for the previous and the next smaller position in that
   order give every place its longest previous factor and the place that shows it. Where it reaches 50, the
   string repeats an earlier one; if that one's document has a smaller id, it goes. The answer is one bit per string.
4. Chunks mark the bytes that the strings cover.

A chunk sends a string once, however often it occurs there, so copies in a third of all documents make no
large group; buckets are of equal size since they go by hash. An anchor with many different segments, as of a
passage that stands between other words in every document, is hot: its strings are sent one by one, filed by a
hash of the string itself, so they spread over all buckets.

Defined results: a null text is empty; a row without an id counts as having the largest long; rows with
equal ids never remove each other's text; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stratadoc.llm.common import narrow, ragged, ready, slices, text_bytes
from stratadoc.llm.wordhash import mix, prefix_sums, slice_hashes
from stratadoc.session import durable

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 2 << 20
#: Text per bucket.
BUCKET_BYTES = 6 << 20
#: Strings of one segment at most; one bit of an answer each.
MOST_STRINGS = 32
#: An anchor is hot if its chunks send so many segments of it, about a megabyte and a half, that are not all the same few.
HOT_SEGMENTS = 20_000
HOT_KINDS = 32
NO_ID = np.iinfo(np.int64).max
CHUNK = "chunk long, docs long, bytes long, ids binary, named binary, sizes binary, data binary"
MESSAGE = "bucket int, chunk long, payload binary"


def pack_chunks(docs: DataFrame) -> DataFrame:
    """Documents ``(doc_id, text)`` as rows of about ``CHUNK_BYTES`` of text, compressed. Stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []

        def close() -> pa.RecordBatch:
            ids, named, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            data = b"".join(h[3] for h in held)
            packed = pa.compress(data, codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (part + seq, len(ids), len(data))] + [pa.array([v], pa.binary()) for v in (ids.tobytes(), named.tobytes(), sizes.tobytes(), packed)],
                names=["chunk", "docs", "bytes", "ids", "named", "sizes", "data"],
            )

        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                flat, at = text_bytes(batch.column("text"))
                ids = batch.column("doc_id")
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                held.append((ids.fill_null(NO_ID).to_numpy(), named, np.diff(at), flat.tobytes()))
                if sum(len(h[3]) for h in held) >= CHUNK_BYTES:
                    yield close()
                    seq, held = seq + 1, []
        if held:
            yield close()

    return durable(docs.mapInArrow(pack, CHUNK))


@dataclass
class Chunk:
    """A chunk with its segments: where they start, how many strings they hold, document and anchor code."""

    ids: np.ndarray
    at: np.ndarray
    data: np.ndarray
    start: np.ndarray
    strings: np.ndarray
    row: np.ndarray
    code: np.ndarray


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each of the first ``n`` places."""
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    eight = [np.ndarray((n,), "<u8", padded.data, offset=8 * k, strides=(1,)) for k in range(GRAM // 8)]
    out = eight[0] * np.uint64(0x9E3779B97F4A7C15)
    for part, factor in zip(eight[1:], (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(31)
        out += part
        out *= np.uint64(factor)
    out ^= out >> np.uint64(29)
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values from each place that has as many."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _code(spread: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash in one number."""
    return ((spread >> np.uint64(33)) % np.uint64(buckets)) << np.uint64(32) | spread & np.uint64(0xFFFFFFFF)


def open_chunk(row: dict, buckets: int) -> Chunk:
    """Segments of a stored chunk."""
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    data = np.frombuffer(pa.decompress(row["data"], row["bytes"], codec="zstd", asbytes=True), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Chunk(ids, at, data, none, none, none, none.astype(np.uint64))
    # Strings that end within their text; their grams do so too.
    place = ragged(at[:-1], np.maximum(sizes - LENGTH + 1, 0))
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    anchor = _smallest(_grams(data, len(data) - GRAM + 1), LENGTH - GRAM + 1)[place]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1])
    number = np.arange(len(place))
    new |= (number - np.maximum.accumulate(np.where(new, number, 0))) % MOST_STRINGS == 0
    first = np.flatnonzero(new)
    return Chunk(ids, at, data, place[first], np.diff(first, append=len(place)), owner[first], _code(mix(anchor[first]), buckets))


def _contents(c: Chunk) -> np.ndarray:
    """Hash of the bytes of each segment."""
    return mix(slice_hashes(prefix_sums(c.data), c.start, c.start + c.strings + LENGTH - 1) + c.strings.astype(np.uint64))


def _distinct_codes(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, the place of each segment's code among them, and whether several ids hold it."""
    codes, place = np.unique(c.code, return_inverse=True)
    if len(codes) == 0:
        return codes, place, np.zeros(0, bool)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(codes)))
    ids = c.ids[c.row[order]]
    return codes, place, np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)


def _variety(place: np.ndarray, content: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per code how many different segments a chunk has of it, 255 at most, and a byte of one of them."""
    order = np.lexsort((content, place))
    new = np.ones(len(order), bool)
    new[1:] = (place[order][1:] != place[order][:-1]) | (content[order][1:] != content[order][:-1])
    number = np.minimum(np.bincount(place[order][new], minlength=codes), 255).astype(np.uint8)
    first = np.searchsorted(place[order], np.arange(codes))
    return number, content[order][first].astype(np.uint8)


def _by_bucket(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``bucket, first, last`` of codes in order."""
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    if len(bucket):
        limits = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
            yield int(bucket[a]), a, b


def _answers(row: dict, name: str) -> dict[int, bytes]:
    return {a["bucket"]: a["payload"] for a in row[name] or ()}


def _repeated(c: Chunk, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which segments have an anchor that several documents hold, and which a hot one."""
    codes, place, several = _distinct_codes(c)
    hot = np.zeros(len(codes), bool)
    for bucket, a, b in _by_bucket(codes):
        bits = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=2 * (b - a)).astype(bool)
        several[a:b] |= bits[: b - a]
        hot[a:b] = bits[b - a :]
    return (several[place], hot[place]) if len(codes) else (np.zeros(0, bool), np.zeros(0, bool))


@dataclass
class Segments:
    """Pieces that may repeat, and the distinct ones of them by code."""

    at: np.ndarray  # every piece: where it starts, its strings, its document
    held: np.ndarray
    row: np.ndarray
    number: np.ndarray  # the distinct piece of each
    code: np.ndarray
    content: np.ndarray
    strings: np.ndarray
    start: np.ndarray
    least_id: np.ndarray


def distinct_segments(c: Chunk, answers: dict[int, bytes], buckets: int) -> Segments:
    """What a chunk sends in step 3; the same again in step 4."""
    several, hot = _repeated(c, answers)
    whole, split = np.flatnonzero(several & ~hot), np.flatnonzero(several & hot)
    sums = prefix_sums(c.data)
    # Strings of hot segments one by one.
    single = ragged(c.start[split], c.strings[split])
    at = np.concatenate([c.start[whole], single])
    held = np.concatenate([c.strings[whole], np.ones(len(single), np.int64)])
    row = np.concatenate([c.row[whole], np.repeat(c.row[split], c.strings[split])])
    content = mix(slice_hashes(sums, at, at + held + LENGTH - 1) + held.astype(np.uint64))
    own = mix(content[len(whole) :])
    code = np.concatenate([c.code[whole], _code(own, buckets)])
    ids = c.ids[row]
    order = np.lexsort((ids, content, code))
    new = np.ones(len(at), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (content[order][1:] != content[order][:-1])
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    return Segments(at, held, row, number, code[one], content[one], held[one], at[one], ids[one])


def _message(bucket: list[int], chunk: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary())], names=["bucket", "chunk", "payload"]
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for number in range(batch.num_rows):
            yield batch.slice(number, 1).to_pylist()[0]


def _send_anchors(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = open_chunk(row, buckets)
            codes, place, _ = _distinct_codes(c)
            number, byte = _variety(place, _contents(c), len(codes))
            parts = [
                (bucket, row["chunk"], codes[a:b].astype(np.uint32).tobytes() + number[a:b].tobytes() + byte[a:b].tobytes())
                for bucket, a, b in _by_bucket(codes)
            ]
            yield _message(*map(list, zip(*parts))) if parts else _message([], [], [])

    return send


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Of the anchors of one bucket, which are held by several chunks, and which are hot."""
    held, number, byte = [], [], []
    for payload in table.column("payload").to_pylist():
        n = len(payload) // 6
        held.append(np.frombuffer(payload, np.uint32, n))
        number.append(np.frombuffer(payload, np.uint8, n, 4 * n))
        byte.append(np.frombuffer(payload, np.uint8, n, 5 * n))
    codes, place = np.unique(np.concatenate(held), return_inverse=True)
    several = np.bincount(place) > 1
    number, byte = np.concatenate(number), np.concatenate(byte)
    hot = np.bincount(place, number) >= HOT_SEGMENTS
    for code in np.flatnonzero(hot).tolist():
        own = place == code
        hot[code] = number[own].max() >= HOT_KINDS or len(np.unique(byte[own])) >= HOT_KINDS
    limits = np.cumsum([len(h) for h in held])[:-1]
    parts = [np.concatenate(p) for p in zip(np.split(several[place], limits), np.split(hot[place], limits))]
    answer = pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
    return table.select(["bucket", "chunk"]).append_column("payload", answer)


_FIELDS = (("code", "<u4"), ("content", "<u8"), ("strings", "u1"), ("least_id", "<i8"))


def _send_segments(buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = open_chunk(row, buckets)
            s = distinct_segments(c, _answers(row, "anchors"), buckets)
            parts = []
            for bucket, a, b in _by_bucket(s.code):
                values = c.data[ragged(s.start[a:b], s.strings[a:b] + LENGTH - 1)]
                arrays = [np.array([b - a], "<i8"), *[getattr(s, f)[a:b].astype(kind) for f, kind in _FIELDS], values]
                parts.append((bucket, row["chunk"], b"".join(x.tobytes() for x in arrays)))
            yield _message(*map(list, zip(*parts))) if parts else _message([], [], [])

    return send


def suffix_order(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``places``, cut at ``LENGTH`` bytes, and how long neighbours in it agree.

    Ranks of 8 bytes are doubled to 16 and 32 and joined to 50. Equal strings stand in order of position.
    The second array holds for each suffix its agreement with the one before, ``LENGTH`` at most.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    eight = np.ndarray((n + 32,), ">u8", padded.data, strides=(1,)).astype(np.uint64)
    ranks = [np.unique(eight, return_inverse=True)[1].astype(np.uint64)]
    for step in (8, 16):
        joined = (ranks[-1][:-step] << np.uint64(32)) | ranks[-1][step:]
        rank = np.unique(joined, return_inverse=True)[1].astype(np.uint64)
        # A place too near the end has no rank of its own; no string of full length begins there.
        ranks.append(np.concatenate([rank, np.zeros(step, np.uint64)]))
    whole = (ranks[2][places] << np.uint64(32)) | ranks[2][places + LENGTH - 32]
    order = np.argsort(whole, kind="stable")
    agree = np.zeros(len(order), np.int64)
    same = whole[order][1:] == whole[order][:-1]
    agree[1:][same] = LENGTH
    other = np.flatnonzero(~same) + 1
    x, y = places[order[other - 1]], places[order[other]]
    length = np.zeros(len(other), np.int64)
    for rank, step in zip(ranks[::-1], (32, 16, 8)):
        length += np.where(rank[x + length] == rank[y + length], step, 0)
    differing = eight[x + length] ^ eight[y + length]
    for byte in range(1, 8):
        length += differing < np.uint64(1 << (64 - 8 * byte))
    agree[other] = np.minimum(length, LENGTH - 1)
    return order, agree


def _smaller_before(position: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the nearest earlier entry with a smaller position, -1 if none, and their agreement.

    All entries look one to the left and jump on along the pointers found so far; everything between an
    entry and its pointer has a larger position, so no jump can pass the wanted one.
    """
    at, least = np.arange(-1, len(position) - 1), agree.copy()
    waiting = np.flatnonzero((at >= 0) & (position[at] > position))
    while len(waiting):
        over = at[waiting]
        jumped, shortest = at[over], np.minimum(least[waiting], least[over])
        at[waiting], least[waiting] = jumped, shortest
        waiting = waiting[(jumped >= 0) & (position[jumped] > position[waiting])]
    least[at < 0] = 0
    return at, least


def longest_previous(order: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place its longest previous factor, ``LENGTH`` at most, and an earlier place that shows it, or -1."""
    before, length_before = _smaller_before(order, agree)
    # The same scan from the other end; an entry's agreement with the one after it stands at that one.
    back, length_after = _smaller_before(order[::-1], np.concatenate([agree[1:], [0]])[::-1])
    after = np.where(back < 0, -1, len(order) - 1 - back)[::-1]
    length_after = length_after[::-1]
    chosen = np.where(length_before >= length_after, before, after)
    length, source = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length[order] = np.maximum(length_before, length_after)
    source[order] = np.where(chosen < 0, -1, order[chosen])
    return length, source


def first_copies(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place, the number in ``places`` of the first one with the same ``LENGTH`` bytes; ``places`` ascend.

    A place whose longest previous factor reaches ``LENGTH`` repeats an earlier one, which in turn may do so.
    """
    length, source = longest_previous(*suffix_order(data, places))
    first = np.where(length >= LENGTH, source, np.arange(len(places)))
    while True:
        earlier = first[first]
        if (earlier == first).all():
            return first
        first = earlier


def _answer_segments(table: pa.Table) -> pa.Table:
    """Per segment of each chunk one bit for every string that a document with a smaller id holds too."""
    fields: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS}
    texts, counts = [], []
    for payload in table.column("payload").to_pylist():
        n, at = int(np.frombuffer(payload, "<i8", 1)[0]), 8
        counts.append(n)
        for name, kind in _FIELDS:
            fields[name].append(np.frombuffer(payload, kind, n, at))
            at += fields[name][-1].nbytes
        texts.append(np.frombuffer(payload, np.uint8, -1, at))
    code, content, strings, ids = (np.concatenate(fields[name]) for name, _ in _FIELDS)
    strings = strings.astype(np.int64)
    text = np.concatenate(texts)
    sizes = strings + LENGTH - 1
    start = np.cumsum(sizes) - sizes
    # Distinct segments over all chunks, each with its smallest id.
    order = np.lexsort((ids, content, code))
    new = np.ones(len(code), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (content[order][1:] != content[order][:-1])
    number = np.empty(len(code), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    least = ids[one]
    # Only anchors with several distinct segments need a suffix order.
    kinds = np.unique(code[one], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(kinds[2][kinds[1]] > 1)
    mixed = mixed[np.argsort(least[mixed], kind="stable")]
    value_at = np.full(len(one), -1, np.int64)
    values = np.zeros(0, np.int64)
    if len(mixed):
        own = one[mixed]
        data = text[ragged(start[own], sizes[own])]
        places = ragged(np.cumsum(sizes[own]) - sizes[own], strings[own])
        holder = np.repeat(mixed, strings[own])
        values = least[holder[first_copies(data, places)]]
        value_at[mixed] = np.cumsum(strings[own]) - strings[own]
    every = ((np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    answer = np.where(least[number] < ids, every, 0).astype(np.uint32)
    again = np.flatnonzero(value_at[number] >= 0)
    if len(again):
        n = strings[again]
        earlier = values[ragged(value_at[number[again]], n)] < np.repeat(ids[again], n)
        first = np.cumsum(n) - n
        bit = np.arange(int(n.sum())) - np.repeat(first, n)
        answer[again] = np.add.reduceat(earlier.astype(np.uint64) << bit.astype(np.uint64), first).astype(np.uint32)
    parts = np.split(answer, np.cumsum(counts)[:-1])
    return table.select(["bucket", "chunk"]).append_column("payload", pa.array([p.tobytes() for p in parts], pa.binary()))


def removed_bytes(c: Chunk, anchors: dict[int, bytes], segments: dict[int, bytes], buckets: int) -> np.ndarray:
    """Truth values, one per byte of the chunk."""
    s = distinct_segments(c, anchors, buckets)
    bits = np.zeros(len(s.code), np.uint32)
    for bucket, a, b in _by_bucket(s.code):
        bits[a:b] = np.frombuffer(segments[bucket], np.uint32)
    strings, start = s.held, s.at
    # A later document of the same chunk repeats all strings of the segment.
    later = c.ids[s.row] > s.least_id[s.number]
    own = np.where(later, np.uint32(0xFFFFFFFF), bits[s.number])
    offset = np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    hit = (np.repeat(own, strings) >> offset.astype(np.uint32)) & np.uint32(1) == 1
    at = (np.repeat(start, strings) + offset)[hit]
    change = np.bincount(at, minlength=len(c.data) + 1) - np.bincount(at + LENGTH, minlength=len(c.data) + 1)
    return np.cumsum(change)[:-1] > 0


def _finish(buckets: int, with_text: bool) -> Callable:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = open_chunk(row, buckets)
            gone = removed_bytes(c, _answers(row, "anchors"), _answers(row, "segments"), buckets)
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            limit = np.zeros(len(gone) + 1, bool)
            limit[c.at] = True
            opened = gone & (~before | limit[:-1])
            sums, spans = (np.concatenate([[0], np.cumsum(x)])[c.at] for x in (gone, opened))
            kept = [c.data[a:b][~gone[a:b]].tobytes() for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist())]
            columns = [
                pa.array(c.ids, pa.int64(), mask=~np.frombuffer(row["named"], bool)),
                pa.array(np.diff(c.at)),
                pa.array(np.diff(sums)),
                pa.array(np.diff(spans)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return finish


def _exchange(messages: DataFrame, answer: Callable, name: str) -> DataFrame:
    """Answers of all buckets, gathered per chunk."""
    answered = messages.groupBy("bucket").applyInArrow(answer, MESSAGE)
    return durable(answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(name)))


def remove_repeats(docs: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, and ``kept_text`` if wanted.

    In ``kept_text``, bytes of a character that was cut through are left out.
    """
    spark = ready(docs.sparkSession)
    chunks = pack_chunks(narrow(docs, doc_id=doc_id, text=text))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES, 1)
    anchors = _exchange(chunks.mapInArrow(_send_anchors(buckets), MESSAGE), _answer_anchors, "anchors")
    known = chunks.join(anchors, "chunk", "left")
    segments = _exchange(known.mapInArrow(_send_segments(buckets), MESSAGE), _answer_segments, "segments")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return known.join(segments, "chunk", "left").mapInArrow(_finish(buckets, with_text), schema)

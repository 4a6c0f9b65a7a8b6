"""Encoding of whole texts with a public tokenizer, at the speed of its distinct words."""

from __future__ import annotations

import gc
import re
import sys
import types
from codecs import charmap_decode
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratadoc.llm.common import ragged, text_bytes

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Pieces that hold only these characters split into words in a known way; apostrophes are left out, as
#: they may begin a contraction, and so is all else, which the library itself splits.
_RUN = rf"(?:[{_LETTERS}]++|[0-9]++|[{_MARKS}]++)"
_PLAIN = {"lead": re.compile(rf"[ \n]?{_RUN}(?:\n?{_RUN})*+"), "drop": re.compile(rf"\n?{_RUN}(?:\n?{_RUN})*+")}
_WORD = {
    "lead": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n"),
    "drop": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+"),
}
#: One word; where spaces lead, the mark may stand before it.
_SINGLE = {"lead": rf"\A\x00?[{_LETTERS}]+\z", "drop": rf"\A[{_LETTERS}]+\z"}
#: A word ends between a letter and one of these, whatever stands before or after.
_WORD_END = f"([{_LETTERS}])([.,;:!?\n])"


def _byte_letters() -> str:
    """The 256 printable characters that stand for the bytes in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others are numbered from 256 on; so a space is
    U+0120 and a line end U+010A.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    shown = {b: 256 + n for n, b in enumerate(others)}
    return "".join(chr(shown.get(b, b)) for b in range(256))


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit polynomial hashes of the strings' bytes."""
    flat, at = text_bytes(strings)
    if len(flat) == 0:
        return np.zeros(len(strings), np.uint64)
    sizes = np.diff(at)
    factor = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)
    values = np.multiply.accumulate(factor)[np.arange(len(flat)) - np.repeat(at[:-1], sizes)]
    values *= flat + np.uint64(1)
    # Sums wrap around, differences as well.
    sums = np.append(np.uint64(0), np.cumsum(values))
    return sums[at[1:]] - sums[at[:-1]]


class WordwiseEncoder:
    """Ids of texts, worked out once per distinct word.

    The tokenizers named below split a text into words before they merge anything, so a text's ids are
    those of its pieces, one after the other. Texts are cut at single spaces and between a letter and a
    punctuation mark or line end, by Arrow, which also finds the distinct pieces. A new piece of plain
    letters, digits and marks is cut into words here, and the library's model merges each distinct word;
    any other piece is encoded by the whole library. A text in which a cut at a space could change the
    words is encoded as a whole.

    ``spaces="lead"``: a space belongs to the word after it (byte-level vocabularies).
    ``spaces="drop"``: white space only separates, case is folded (vocabularies with word ends).
    """

    def __init__(self, path: str, spaces: str, most_words: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True  # their strings in a text are ordinary text
        #: Bytes that any id of the vocabulary fits in.
        self.width = 2 if self._library.get_vocab_size() <= 1 << 16 else 4
        self._lead = spaces == "lead"
        self._plain, self._word, self._single = _PLAIN[spaces], _WORD[spaces], _SINGLE[spaces]
        self._letters = _byte_letters()
        self._most = most_words
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.large_string())
        #: Hashes of the known pieces in order, and the number of each. Looking pieces up among them costs
        #: what the pieces of a batch cost; Arrow's own lookup hashes all known ones again for every batch.
        self._hashes, self._places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._pool = [np.zeros(0, np.uint32)]
        self._lengths = [np.zeros(0, np.int64)]
        self._unsafe = [np.zeros(0, bool)]

    def _ids(self, pieces: list[str], single: list[bool]) -> list[list[int]]:
        """Ids of distinct pieces as they stand in a text; ``single`` ones are one word of letters."""
        out: list[list[int]] = []
        other: list[int] = []
        merged: dict[str, list[int]] = {}
        lead, letters = self._lead, self._letters
        known, merge, words, plain = merged.get, self._library.model.tokenize, self._word.findall, self._plain.fullmatch
        joined = "\n".join(compress(pieces, single))
        shown = charmap_decode((joined if lead else joined.lower()).encode(), "strict", letters)[0]
        # Most pieces are such words; they are shown together and need not be looked up.
        of_words = iter([[token.id for token in merge(word)] for word in shown.split(letters[10])] if joined else [])
        for number, piece in enumerate(pieces):
            if single[number]:
                out.append(next(of_words))
                continue
            if plain(piece):
                parts = words(piece if lead else piece.lower())
            else:
                other.append(number)
                out.append([])
                continue
            ids: list[int] = []
            for word in parts:
                found = known(word)
                if found is None:
                    if word.isascii():
                        shown = "\u0120" + word[1:] if word[0] == " " else "\u010a" if word == "\n" else word
                    else:
                        shown = charmap_decode(word.encode(), "strict", letters)[0]
                    found = merged[word] = [token.id for token in merge(shown)]
                ids = ids + found if ids else found
            out.append(ids)
        encoded = self._library.encode_batch_fast([pieces[n] for n in other], add_special_tokens=False)
        for number, e in zip(other, encoded):
            out[number] = e.ids
        return out

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces, each new one encoded first."""
        hashes = _hashes(pieces)
        rising = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[rising] = np.searchsorted(self._hashes, hashes[rising])
        found = place < len(self._hashes)
        found[found] = self._hashes[place[found]] == hashes[found]
        numbers = np.full(len(pieces), -1)
        numbers[found] = self._places[place[found]]
        # Equal hashes are no proof; a piece that shares its hash with an earlier one is new every time.
        same = pc.equal(self._known.take(pa.array(numbers[found])), pieces.filter(pa.array(found)))
        numbers[np.flatnonzero(found)[~same.to_numpy(zero_copy_only=False)]] = -1
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            new = pieces.take(pa.array(fresh))
            numbers[fresh] = len(self._known) + np.arange(len(fresh))
            self._known = pa.concat_arrays([self._known, new])
            order = np.argsort(hashes[fresh])
            at = place[fresh][order]
            self._hashes = np.insert(self._hashes, at, hashes[fresh][order])
            self._places = np.insert(self._places, at, numbers[fresh][order])
            # With leading spaces, a piece that follows none is marked.
            shown = new.to_pylist()
            single = pc.match_substring_regex(new, self._single).to_pylist()
            ids = self._ids([x[1:] if x[:1] == "\0" else " " + x for x in shown] if self._lead else shown, single)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._pool.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
            self._lengths.append(lengths)
            if self._lead:
                # A piece whose last byte is a visible ASCII character is safe; only the others are looked at.
                flat, at = text_bytes(new)
                last = np.append(flat, np.uint8(0))[np.maximum(at[1:] - 1, 0)]
                unsafe = (at[1:] == at[:-1]) | (last <= 0x20) | (last >= 0x7F)
                for n in np.flatnonzero(unsafe).tolist():
                    unsafe[n] = shown[n] in ("", "\0") or shown[n][-1].isspace()
                self._unsafe.append(unsafe)
        return numbers

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and the number of pieces of each text."""
        if self._lead:
            mark, nothing = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
            marked = pc.binary_join_element_wise(mark, texts, nothing)
            cut = pc.replace_substring_regex(marked, _WORD_END, "\\1 \0\\2")
        else:
            cut = pc.replace_substring_regex(texts, _WORD_END, "\\1 \\2")
        cut = pc.split_pattern(cut, " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        if not self._lead:
            return numbers, counts
        # A piece that ends in white space, or an empty one, may be part of a run that was cut.
        self._unsafe = [np.concatenate(self._unsafe)]
        unsafe = np.zeros(len(counts), bool)
        unsafe[np.searchsorted(np.cumsum(counts), np.flatnonzero(self._unsafe[0][numbers]), "right")] = True
        # The mark may stand in a text itself.
        doubtful = np.flatnonzero(unsafe | pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False))
        if len(doubtful) == 0:
            return numbers, counts
        whole = [self._library.encode(texts[t].as_py(), add_special_tokens=False).ids for t in doubtful.tolist()]
        # Such a text is one piece for this call only.
        first = len(self._known) + len(self._extra)
        self._extra += whole
        parts = np.split(numbers, np.cumsum(counts)[:-1])
        for k, t in enumerate(doubtful.tolist()):
            parts[t] = np.array([first + k])
        counts[doubtful] = 1
        return np.concatenate(parts), counts

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text. ``end_id`` follows every text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = column.cast(pa.large_string()).fill_null("")
        if len(self._known) > self._most:
            self._forget()
        self._extra: list[list[int]] = []
        collecting = gc.isenabled()
        gc.disable()  # millions of short-lived strings, no cycles
        try:
            word, pieces = self._cut(column)
        finally:
            if collecting:
                gc.enable()
        self._pool, self._lengths = [np.concatenate(self._pool)], [np.concatenate(self._lengths)]
        pool, lengths = self._pool[0], self._lengths[0]
        if self._extra:
            extra = np.array([len(x) for x in self._extra], np.int64)
            pool = np.concatenate([pool, np.fromiter(chain.from_iterable(self._extra), np.uint32, int(extra.sum()))])
            lengths = np.concatenate([lengths, extra])
        starts = np.cumsum(lengths) - lengths
        ids = pool[ragged(starts[word], lengths[word])]
        ends = np.concatenate([[0], np.cumsum(lengths[word])])[np.cumsum(pieces)]
        counts = np.diff(ends, prepend=0)
        if end_id is None:
            return ids, counts
        return np.insert(ids, ends, np.uint32(end_id)), counts + 1


def process_encoder(path: str, spaces: str) -> WordwiseEncoder:
    """The encoder of this worker process, kept between tasks, since later tasks meet the same words."""
    held = sys.modules.setdefault("stratadoc_encoders", types.ModuleType("stratadoc_encoders")).__dict__
    if (path, spaces) not in held:
        held[path, spaces] = WordwiseEncoder(path, spaces)
    return held[path, spaces]

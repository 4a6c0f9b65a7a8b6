"""Words of whole texts as 64-bit hashes, worked out on the bytes of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Bytes with A-Z turned into a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking value for every byte.
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(count: int, which: str = "up") -> np.ndarray:
    """The base, or its inverse, to the powers 0 .. count - 1 modulo 2**64."""
    have = _powers[which]
    factor = _BASE if which == "up" else _INVERSE
    while len(have) < count:
        step = np.uint64(pow(factor, len(have), 1 << 64) & _MASK)
        have = np.concatenate([have, have * step])
    _powers[which] = have
    return have[:count]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes, one more entry than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte slice; equal slices have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), "down")[starts])


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts. ``first`` has one more entry than texts."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    row: np.ndarray
    data: np.ndarray

    def text(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b``, lower-cased, with one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def words(flat: np.ndarray, at: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Maximal runs of ``word_bytes`` (a table of 256 truth values) within each text, A-Z lower-cased."""
    data = LOWER[flat]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    limit = np.zeros(len(data) + 1, bool)
    limit[at] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | limit))
    ends = np.flatnonzero(before & (~inside | limit))
    hashes = slice_hashes(prefix_sums(data), starts, ends)
    first = np.searchsorted(starts, at)
    return Words(starts, ends, hashes, first, np.repeat(np.arange(len(at) - 1), np.diff(first)), data)


def gram_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    n = len(w.hashes)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += mix(w.hashes[k:] + np.uint64((k + 1) * _BASE & _MASK))
    valid = np.zeros(n, bool)
    if n >= size:
        valid[: n - size + 1] = w.row[: n - size + 1] == w.row[size - 1 :]
    return mix(total), valid

"""Words and word-window fingerprints of many texts at once, in numpy over Arrow's own buffers.

A word is a run of bytes other than space and 0x09-0x0D.  Fingerprints are polynomial hashes modulo 2**64, taken
from one prefix sum, so that the hash of any window of any length costs two look-ups and a multiplication.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BREAK = np.zeros(256, bool)
BREAK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)  # odd, hence invertible modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = out[0], out[1]
        if size <= 1 << 22:  # a rare huge text does not stay in memory
            _powers[which] = have
    return have


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _pow(which, len(values))[0][: len(values)], out=out[1:])
    return out


@dataclass
class Words:
    """data: all bytes; start, end: of each word in data; doc: its row; hash: of its bytes; first: each row's first word, and the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def windows(self, n: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each word on, and whether they are of one row; ``which`` 2 is another hash."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        sums = prefix(self.hash, which)
        out = mix((sums[n:] - sums[:-n]) * _pow(which, len(self.hash))[1][:count])
        return out, self.doc[: count] == self.doc[n - 1 :]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array, lower: bool = False, breaks: np.ndarray = BREAK) -> Words:
    data, at = buffers(column)
    if lower:
        data = LOWER[data]
    size = len(data)
    solid = np.empty(size + 1, bool)
    solid[:size] = ~breaks[data]
    solid[size] = False
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = at[1:-1][at[1:-1] < size]
    opens[edges] = solid[edges]
    start = np.flatnonzero(opens)
    shuts = np.zeros(size + 1, bool)
    shuts[1:] = solid[:-1] & ~solid[1:]
    shuts[edges] |= (edges > 0) & solid[np.maximum(edges - 1, 0)]
    end = np.flatnonzero(shuts)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    sums = prefix(data.astype(np.uint64) + np.uint64(1), 0)
    hashes = mix((sums[end] - sums[start]) * _pow(0, size + 1)[1][start])
    return Words(data, start, end, doc, hashes, first)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct n-word windows, hashed; a row with fewer words has its whole sequence as one.

    Returns (hash, row, offsets of the rows): sorted by hash within a row.
    """
    rows = len(w.first) - 1
    win, one = w.windows(n)
    keys, doc = win[one], w.doc[: len(win)][one]
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        sums = prefix(w.hash, 1)
        a, b = w.first[few], w.first[few + 1]
        whole = mix((sums[b] - sums[a]) * _pow(1, len(w.hash) + 1)[1][a] + count[few].astype(np.uint64))
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, few])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, doc, np.searchsorted(doc, np.arange(rows + 1))


def digest128(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of scrambled keys for each run: equal sets give equal pairs."""
    out = []
    for salt in (0x1234567, 0x7654321):
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mix(keys + np.uint64(salt)), out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]

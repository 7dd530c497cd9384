"""Words and word hashes of whole Arrow batches of texts, with numpy.

Texts are handled in their UTF-8 bytes, a few at a time: a step holds at most ``STEP`` bytes, or one
text where that is longer, and a longer text is hashed in pieces that end between two words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

STEP = 1 << 20

#: Bytes that separate words: white space only.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words: all ASCII but digits and letters.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Maps A-Z to a-z, other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_random = np.random.default_rng(20240229)
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 … n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = powers(_BASE, STEP)
_DOWN = powers(pow(_BASE, -1, 1 << 64), STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each text starts (one entry more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows ``[a, b)`` that hold at most ``STEP`` bytes, or one row."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never reaches over the end of its text."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(data) <= STEP:
        return _hash_piece(data, starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + STEP, "right")))
        if j == i + 1 and ends[i] - at > STEP:  # one word longer than a piece
            whole = np.zeros(1, np.uint64)
            for k in range(at, int(ends[i]), STEP):
                part = data[k : min(k + STEP, int(ends[i]))]
                whole = mix(whole + _hash_piece(part, np.array([0]), np.array([len(part)])))
            out[i] = whole[0]
        else:
            out[i:j] = _hash_piece(data[at : int(ends[j - 1])], starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def rolling(hashes: np.ndarray, width: int, seed: int = 0x51) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive values; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed], np.uint64))[0] | np.uint64(1)
    values = mix(hashes + np.uint64(seed))
    out = np.zeros(n, np.uint64)
    # Doubling: a hash of 2k values is made of two hashes of k values.
    done, block, size = 0, values, 1
    rest = width
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = mix(out * base + part)
            done += size
        rest >>= 1
        if rest:
            block = mix(block[:-size] * base + mix(block[size:])) if len(block) > size else block[:0]
            size *= 2
    return out


class Step(NamedTuple):
    """Words of the rows ``first_row …`` of a batch, in the bytes ``data`` of these rows."""

    first_row: int
    data: np.ndarray
    #: Where each row starts in ``data``; one entry more than rows.
    cuts: np.ndarray
    #: Bounds of all words in ``data``.
    starts: np.ndarray
    ends: np.ndarray
    #: For each row the index of its first word; one entry more than rows.
    first: np.ndarray

    @property
    def rows(self) -> range:
        return range(len(self.first) - 1)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)


def words_of(column: pa.Array, separators: np.ndarray, fold: bool = False) -> Iterator[Step]:
    data, offsets = texts_of(column)
    for a, b in steps(offsets):
        piece = data[offsets[a] : offsets[b]]
        if fold:
            piece = LOWER[piece]
        cuts = offsets[a : b + 1] - offsets[a]
        starts, ends = word_bounds(piece, cuts, separators)
        yield Step(a, piece, cuts, starts, ends, np.searchsorted(starts, cuts))

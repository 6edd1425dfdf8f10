"""Texts of an Arrow batch as one byte array: words, hashes and sums without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from almenara import session  # noqa: F401  functions of this package travel with their code

PIECE_BYTES = 1 << 20
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
LETTER = UPPER | LOWER
LETTER[128:] = True
WORD = LETTER | DIGIT

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(PIECE_BYTES + 64, 1 << int(n).bit_length())
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the ``len + 1`` offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with about ``limit`` bytes of whole texts: (first row, last row + 1, bytes, offsets from 0)."""
    data, at = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` bytes, cut at text borders: starts, ends and the text each belongs to."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(n + 1, bool)
    first[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, at))
    return starts, ends, np.repeat(np.arange(len(at) - 1), counts)


def summed(values: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero, wrapping for unsigned values."""
    out = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Hasher:
    """Polynomial hashes of any byte ranges of one piece; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        self.base = (PRIME + 2 * (seed * 0x51ED2701 + 1)) | 1
        weights = powers(self.base, len(data))
        self.total = summed((data.astype(np.uint64) + np.uint64(1)) * (data != 0) * weights)
        self.back = powers(pow(self.base, -1, 1 << 64), len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.back[starts])


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case ASCII and two-byte Latin letters; also which bytes end an upper-case letter."""
    out = data.copy()
    upper = UPPER[data]
    out[upper] += 32
    latin = np.zeros(len(data), bool)
    if len(data) > 1:
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out, upper | latin


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA5A5A5A5A5A5A5A5)))

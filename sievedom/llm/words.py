"""Words of whole Arrow columns as numpy arrays, without a Python loop over texts or words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once; a longer text is taken alone, as a whole.
SLICE = 1 << 20

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    p = np.full(1 << bits, base, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(max(1, int(n - 1).bit_length()), int(base))[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[start:end], by prefix sums of a polynomial of the bytes' numbers."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(of[data] * powers(max(1, len(data)), _BASE)[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * powers(len(data) + 1, _BACK)[start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Some rows' texts: their bytes, each text's place in them, and the words by ASCII white space."""

    rows: slice
    data: np.ndarray
    at: np.ndarray  # n + 1 places in data
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # n + 1 places in the words

    def __len__(self) -> int:
        return len(self.at) - 1

    def hashes(self, other: bool = False) -> np.ndarray:
        """64-bit hashes of the words, or others that tell words of one hash apart."""
        return span_hashes(self.data, self.start, self.end, _OTHER if other else _BYTE)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def sums_by_text(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of values[places[i]:places[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[places])


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Texts]:
    """The texts of a string column (null: empty) in slices of about SLICE bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, len(column))
        data, at = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            data = _LOWER[data]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_SPACE[data]
        begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]  # a word ends with its text
        begins[inner] = solid[1:-1][inner]
        ends[inner - 1] = solid[1:-1][inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Texts(slice(i, j), data, at, start, end, np.searchsorted(start, at))
        i = j


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k words in a row of one text, and the place of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    place = np.flatnonzero(np.arange(n) + k <= last)
    return mixed(total[place]), place

"""Words of whole texts as arrays: byte classes, word spans and 64-bit hashes in numpy.

Texts of an Arrow batch are worked on in slices of bounded size, so memory follows the
slice (or one very long text), not the batch. A null text counts as an empty one. Words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_SEED = 20_240_607


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans, true within the given inclusive byte ranges."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; bytes of code points above 0x7F are word bytes.
ALNUM = ~byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            table[1:] = np.uint64(base)
            tables.append(np.multiply.accumulate(table))
        if n > 4 * SLICE_BYTES:
            return tables[0], tables[1]  # for one very long text only
        _powers[:] = tables
    return _powers[0], _powers[1]


class Texts:
    """Some texts: their bytes end to end, and where each begins."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data, self.n = offsets, data, len(offsets) - 1
        self._sums: np.ndarray | None = None

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte, end byte) of each maximal run of bytes that are inside."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        first[edge] = inside[edge]
        edge = self.offsets[1:][self.offsets[1:] > 0] - 1
        last[edge] = inside[edge]
        start = np.flatnonzero(first)
        return self.text_of(start), start, np.flatnonzero(last) + 1

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, whatever stands around it."""
        up, down = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_byte_values()[self.data] * up[: len(self.data)], out=self._sums[1:])
        value = (self._sums[end] - self._sums[start]) * down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_text(self, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Entries (or the sum of whole-number weights) for each text."""
        if weights is None:
            return np.bincount(text, minlength=self.n).astype(np.int64)
        return np.rint(np.bincount(text, weights=weights, minlength=self.n)).astype(np.int64)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Bytes of each text with a flag."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def code_points(self) -> np.ndarray:
        return self.count(starts_code_point(self.data))


def starts_code_point(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def texts(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(offsets - offsets[0], data[offsets[0] : offsets[-1]])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows of about `limit` bytes of text, or of one longer text."""
    if not batch.num_rows:
        return
    whole = texts(batch.column(column))
    at = 0
    while at < whole.n:
        stop = int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1
        stop = min(max(stop, at + 1), whole.n)
        offsets = whole.offsets[at : stop + 1]
        yield batch.slice(at, stop - at), Texts(offsets - offsets[0], whole.data[offsets[0] : offsets[-1]])
        at = stop


def shingles(text: np.ndarray, word: np.ndarray, size: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct run of `size` words in a text, sorted by both.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n_words = np.bincount(text, minlength=n_texts)
    places, values = [], []
    for length in range(1, size + 1):
        n = len(word) - length + 1
        if n <= 0:
            continue
        inside = text[:n] == text[length - 1 :]
        if length < size:
            inside &= n_words[text[:n]] == length
        at = np.flatnonzero(inside)
        value = np.full(len(at), length, np.uint64)
        for step in range(length):
            value = mix(value * np.uint64(_BASE) + word[at + step])
        places.append(text[at])
        values.append(value)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return distinct(np.concatenate(places), np.concatenate(values))


def distinct(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (place, value) pairs, sorted."""
    order = np.lexsort((value, place))
    place, value = place[order], value[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (value[1:] != value[:-1])
    return place[new], value[new]

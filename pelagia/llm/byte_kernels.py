"""Numpy kernels over the bytes of Arrow string columns: slices, word and window hashes, winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000  # texts are worked in slices of about so many bytes; a longer text is a slice of its own
LAST_ID = np.iinfo(np.int64).max  # stands for a null id, which sorts last

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, step in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, 2 * len(_powers[i])), step, dtype=np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Prefix polynomial hashes of a sequence of 64-bit values: the hash of any stretch in two look-ups."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Prefixes:
        return cls(_CODES[data])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of [start, end), the same wherever it stands; unmixed."""
        return (self.sums[end] - self.sums[start]) * self.down[start]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins and ends; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stretches of rows with about ``size`` bytes of text: the rows, their bytes, their offsets."""
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def ids_of(rows: pa.RecordBatch, name: str = "id") -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class Words:
    """The words (runs of non-separators) of a slice: text number, first and last byte, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_SEPARATOR[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        first[edges] = solid[edges]
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        last[ends] = solid[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = mix(Prefixes.of_bytes(data).stretch(self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.bounds = np.searchsorted(self.text, np.arange(len(offsets)))  # words of text i: bounds[i] to bounds[i + 1]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-word shingles, ordered by both; a shorter text is one shingle."""
    prefix = Prefixes(words.hash)
    count = np.diff(words.bounds)
    start = np.arange(len(words.hash))
    whole = start[: max(0, len(start) - n + 1)]
    whole = whole[words.text[whole] == words.text[whole + n - 1]]
    short = np.flatnonzero((count > 0) & (count < n))
    begin = np.r_[whole, words.bounds[short]]
    end = np.r_[whole + n, words.bounds[short + 1]]
    text = words.text[begin]
    value = mix(prefix.stretch(begin, end) + (end - begin).astype(np.uint64))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def sliding_first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the first least value among the next ``width`` values."""
    place = np.arange(len(values))
    least = values
    done = 1
    while done < width:
        step = min(done, width - done)
        later = least[step:]
        take = later < least[: len(later)]
        place = np.where(take, place[step:], place[: len(later)])
        least = np.where(take, later, least[: len(later)])
        done += step
    return place

"""Words and word shingles of whole texts as 64-bit hashes, computed column-wise inside a task.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Texts are worked
through in segments of about SEGMENT bytes that end between words, so a very long text needs
memory for its word hashes (8 bytes a word) and not for temporaries of its whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
# rows of one Arrow batch are handled in slices of about this many text bytes
SLICE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about SLICE_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, end to end, and the bounds of each; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class WordHasher:
    """Hashes of the words of a column. Made once per task, because it keeps its power tables."""

    def __init__(self) -> None:
        self._lower = np.arange(256, dtype=np.uint8)
        self._lower[65:91] += 32
        self._space = np.zeros(256, dtype=bool)
        self._space[[32, 9, 10, 11, 12, 13]] = True
        self._powers = self._inverses = np.zeros(0, dtype=np.uint64)

    @property
    def is_space(self) -> np.ndarray:
        """By byte."""
        return self._space

    def _tables(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, SEGMENT)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                    table = np.full(n, base, dtype=np.uint64)
                    table[0] = 1
                    setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def _segment(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts and hashes in one segment; `cuts` are the text borders inside it."""
        word = ~self._space[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._tables(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((self._lower[data].astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=sums[1:])
        poly = (sums[ends] - sums[starts]) * self._inverses[starts]
        return starts, mix(poly + mix((ends - starts).astype(np.uint64)))

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        data, bounds = text_bytes(column)
        starts, hashes = self.located(data, bounds)
        return hashes, np.diff(np.searchsorted(starts, bounds))

    def located(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all words of `text_bytes`."""
        starts, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        lo = 0
        with np.errstate(over="ignore"):
            while lo < len(data):
                hi = self._cut(data, bounds, lo)
                inside = bounds[np.searchsorted(bounds, lo, side="right") : np.searchsorted(bounds, hi, side="left")]
                s, h = self._segment(data[lo:hi], inside - lo)
                starts.append(s + lo)
                hashes.append(h)
                lo = hi
        return np.concatenate(starts), np.concatenate(hashes)

    def _cut(self, data: np.ndarray, bounds: np.ndarray, lo: int) -> int:
        """Where the segment from `lo` ends: between two words or texts."""
        hi = lo + SEGMENT
        if hi >= len(data):
            return len(data)
        border = int(bounds[np.searchsorted(bounds, hi, side="right") - 1])
        spaces = np.flatnonzero(self._space[data[max(lo, hi - 65536) : hi]])
        best = max(border, max(lo, hi - 65536) + int(spaces[-1]) + 1 if len(spaces) else 0)
        if best > lo:
            return best
        following = int(bounds[np.searchsorted(bounds, lo, side="right")])
        while hi < following:  # one word longer than a segment
            spaces = np.flatnonzero(self._space[data[hi : hi + SEGMENT]])
            if len(spaces):
                return min(hi + int(spaces[0]), following)
            hi += SEGMENT
        return following


def windows(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, text by text, and how many each text has."""
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        runs = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            runs = runs * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
        runs = mix(runs)
    each = np.maximum(counts - size + 1, 0)
    ends = np.cumsum(counts)
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    full = each > 0
    np.add.at(keep, (ends - counts)[full], 1)
    np.add.at(keep, (ends - counts + each)[full], -1)
    return runs[np.cumsum(keep)[: len(runs)] > 0], each


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, end to end, and how many each text has.

    A text with fewer than `size` words has the whole sequence as its one shingle; one without
    words has none.
    """
    runs, each = windows(words, counts, size)
    ends, run_ends = np.cumsum(counts), np.cumsum(each)
    sets = []
    for i in range(len(counts)):
        if each[i]:
            sets.append(np.unique(runs[run_ends[i] - each[i] : run_ends[i]]))
        else:
            n = int(counts[i])
            sets.append(windows(words[ends[i] - n : ends[i]], counts[i : i + 1], n)[0] if n else runs[:0])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else runs[:0]), sizes

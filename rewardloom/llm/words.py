"""Words of whole Arrow batches as numpy arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All functions work on the bytes of a text column at once, so no Python object
is made per word. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts handled at once, in bytes; one longer text is handled alone.
SLICE_BYTES = 1 << 20


class Words(NamedTuple):
    """Words of some texts: ``start`` and ``end`` are byte places in ``data``; text ``i`` has words
    ``first[i]`` to ``first[i + 1] - 1``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def give_back() -> None:
    """Return free memory to the system. Python workers outlive their tasks, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    # glibc's call; other C libraries have none.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``most`` bytes of ``column`` (or one row). Free memory is given back before the
    first, when what the worker's last task held has gone, and behind the last."""
    give_back()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, base = 0, 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, upto - at)
            at, base = upto, int(ends[upto - 1])
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one place more than there are texts)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def split(data: np.ndarray, places: np.ndarray, separator: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Words of the texts that begin at ``places``; ``separator`` says of each byte value whether it parts words, ``cuts`` of
    each byte whether a word begins there even behind another."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separator[data]
    # A text's first byte begins a word even if the text before it ends with one.
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    if cuts is not None:
        edge[:-1] |= cuts
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, places))


def spaces() -> np.ndarray:
    """For each byte value whether it is white space."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


def words(column: pa.Array) -> Words:
    return split(*text_bytes(column), spaces())


#: Ranges of code points. Letters of scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Chinese
#: characters), and the punctuation used with Chinese ones.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3105, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
WIDE_MARKS = ((0x3000, 0x3004), (0x3008, 0x3020), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _among(code: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(code >= lo) & (code <= hi) for lo, hi in ranges])


def plain_words(column: pa.Array) -> Words:
    """Words for comparing prose: A-Z in lower case, cut at all ASCII characters but letters and digits and at wide punctuation;
    every letter of a script written without spaces is a word."""
    data, places = text_bytes(column)
    other = np.ones(256, bool)
    other[128:] = False
    for lo, hi in ("09", "az", "AZ"):
        other[ord(lo) : ord(hi) + 1] = False
    data, cuts = lowered(data), None
    lead = np.flatnonzero(data >= 0xE0)
    if len(lead):
        # Arrow's strings are valid UTF-8, so the bytes of a character are there.
        four = data[lead] >= 0xF0
        byte = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        three = (data[lead].astype(np.int64) & 0x0F) << 12 | byte[0] << 6 | byte[1]
        code = np.where(four, (data[lead].astype(np.int64) & 0x07) << 18 | byte[0] << 12 | byte[1] << 6 | byte[2], three)
        alone, mark = _among(code, UNSPACED), _among(code, WIDE_MARKS)
        for k in range(3):
            data[lead[mark] + k] = 0x20
        cuts = np.zeros(len(data) + 4, bool)
        cuts[lead[alone]] = True
        cuts[lead[alone] + 3 + four[alone]] = True
        cuts = cuts[: len(data)]
    return split(data, places, other, cuts)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table[data]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Polynomial hashes modulo 2**64 of byte or word ranges, from running sums; ``seed`` (odd) chooses the function."""

    def __init__(self, seed: int = 0x9E3779B97F4A7C15):
        self.seed, self.inverse = seed | 1, pow(seed | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16)
            self.up, self.down = powers(self.seed, n), powers(self.inverse, n)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of ``values[start:end]`` for each pair; equal ranges have equal hashes wherever they lie."""
        self._tables(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, w: Words, data: np.ndarray | None = None, block: int = 1 << 18) -> np.ndarray:
        """The hash of each word, taking ``block`` bytes at a time."""
        data = w.data if data is None else data
        out = np.empty(len(w.start), np.uint64)
        at = 0
        while at < len(out):
            low = w.start[at]
            upto = max(at + 1, int(np.searchsorted(w.end, low + block, side="right")))
            part = data[low : w.end[upto - 1]].astype(np.uint64) + np.uint64(1)
            out[at:upto] = self.ranges(part, w.start[at:upto] - low, w.end[at:upto] - low)
            at = upto
        return out


def owners(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

"""Vectorised token hashing over Arrow string columns.

Every operator of this subpackage that must look at each word of each text
does it here, on the UTF-8 buffer that Arrow hands over, with a fixed number of
numpy passes per byte and no Python object per word.

Words are maximal runs of word bytes.  ``SPACE`` words are separated by ASCII
white space; ``ALNUM`` words consist of ASCII letters and digits and of all
non-ASCII bytes.  ASCII letters are folded to lower case.  A word's hash is
``sum((byte + 1) * BASE**k)`` modulo 2**64 over its bytes, ``k`` counting from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at a time; a longer text is one slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}
_SEQUENCE = np.uint64(0xA24BAED4963EE407)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(SLICE_BYTES + 1, n)
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of the texts first .. first+len(bounds)-2 of a column."""

    first: int
    bounds: np.ndarray  #: word index at which each text starts, and the end
    hash: np.ndarray  #: uint64
    start: np.ndarray  #: byte at which each word starts, within its slice
    end: np.ndarray
    data: np.ndarray  #: the bytes of the slice
    text_start: np.ndarray  #: byte at which each text starts, within the slice

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text's index within the slice, for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(array, word_bytes: np.ndarray = SPACE) -> Iterator[Words]:
    """Words of all texts of a column, some texts at a time, in order."""
    data, offsets = column(array)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        b = min(b, n)
        yield words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], word_bytes, a)
        a = b


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, first: int = 0) -> Words:
    size = len(data)
    inside = word_bytes[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(size, dtype=bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    after = np.zeros(size, dtype=bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(size + 1, dtype=np.uint64)
    value = _LOWER[data].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(BASE, size)
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, size + 1)[start]
    return Words(first, np.searchsorted(start, offsets), h, start, end, data, offsets[:-1])


def prefix_sums(w: Words) -> np.ndarray:
    """Running sums from which the hash of any word sequence follows."""
    n = len(w.hash)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(w.hash ^ _SEQUENCE) * powers(BASE, n), out=out[1:])
    return out


def sequence_hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[first]) * powers(_INVERSE, len(sums))[first])


def grams(w: Words, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the n-word sequence that starts at each word.

    ``valid`` is False where the sequence would leave its text.
    """
    size = len(w.hash)
    if size < n:
        return np.zeros(size, np.uint64), np.zeros(size, bool)
    h = mix(w.hash)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out[: size - n + 1] = out[: size - n + 1] * np.uint64(multiplier) + h[k : size - n + 1 + k]
    left = np.repeat(w.bounds[1:], w.counts()) - np.arange(size)
    return mix(out), left >= n


_SPREAD = np.zeros(256, dtype=np.uint64)
for _byte in range(256):
    _SPREAD[_byte] = sum(((_byte >> k) & 1) << (8 * k) for k in range(8))


def simhash(h: np.ndarray, bounds: np.ndarray, lanes: int = 1) -> np.ndarray:
    """SimHash of the features h[bounds[i]:bounds[i+1]] of each text i.

    64 * lanes bits, as an array of uint64 with one row for each text; a bit is
    set if more than half of the features have it.  Features repeat for weight.
    Bits are counted eight at a time, in the byte lanes of 64-bit integers.
    """
    n = len(bounds) - 1
    out = np.zeros((n, lanes), dtype=np.uint64)
    size = np.diff(bounds)
    rows = np.flatnonzero(size)
    if not len(rows):
        return out
    blocks = -(-size[rows] // 255)
    owner = np.repeat(np.arange(len(rows)), blocks)
    begin = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    starts = bounds[rows][owner] + 255 * (np.arange(len(owner)) - begin[owner])
    half = size[rows].astype(np.int64)[:, None]
    for lane in range(lanes):
        x = mix(h + np.uint64((0xA0761D6478BD642F * (lane + 1)) & _MASK)).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            part = np.add.reduceat(_SPREAD[x[:, k]], starts)
            counts = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
            bits = np.packbits(2 * counts > half, axis=1, bitorder="little")[:, 0]
            out[rows, lane] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out

"""Vectorised words of Arrow text columns: boundaries and 64-bit hashes, without Python strings.

Texts are read as UTF-8 bytes. Both word rules of this subpackage are decided byte by byte:
bytes from 0x80 on always belong to words, so no code point is ever split.
Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one go; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 16

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
#: Words of everything but ASCII white space.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of lower-cased ASCII letters, digits and all non-ASCII characters.
ALNUM = (
    (LOWER >= 0x80) | ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A))
)

_random = np.random.Generator(np.random.PCG64(20240917))
_BYTE_KEYS = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_KEYS = _BYTE_KEYS[LOWER]
_PLACE_KEYS = _random.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_BLOCK_KEY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit keys (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def combine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(first * np.uint64(0x9DDFEA08EB382D69) + (then ^ np.uint64(0x2545F4914F6CDD1D)))


@dataclass
class Piece:
    """Consecutive texts and their words."""

    first: int  #: position of its first text in the batch
    offsets: np.ndarray  #: byte offsets of the texts, one more than texts
    data: np.ndarray  #: bytes of the batch
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    bounds: np.ndarray  #: positions among the words at which texts begin, and the end

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """Position of each word's text in the piece."""
        return np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, lower)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def pieces(column: pa.Array, is_word: np.ndarray, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a text column into pieces of about ``most`` bytes and find the words of each."""
    if len(column) == 0:
        return
    offsets, data = text_bytes(column)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        part = offsets[first:last + 1]
        low, high = int(part[0]), int(part[-1])
        inside = is_word[data[low:high]]
        cut = np.zeros(high - low + 1, bool)
        cut[part - low] = True
        before = np.empty(high - low, bool)
        after = np.empty(high - low, bool)
        if high > low:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        start = np.flatnonzero(inside & (~before | cut[:-1])) + low
        end = np.flatnonzero(inside & (~after | cut[1:])) + low + 1
        yield Piece(first, part, data, start, end, np.searchsorted(start, part))
        first = last


def texts_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    """A text column, or the field ``text`` of a column of whole rows: their texts needn't be moved a second time."""
    found = batch.column(column)
    if not pa.types.is_struct(found.type):
        return found
    return found.field([f.name.lower() for f in found.type].index("text"))


def text_apart(columns: list[str]) -> bool:
    """Whether texts stand beside the carried columns, not in a column of whole rows."""
    return "text" in [c.lower() for c in columns]


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column has about ``most`` bytes in each; bounds what is built from one."""
    for batch in batches:
        offsets, _ = text_bytes(texts_of(batch, column % batch.num_columns))
        first = 0
        while first < len(batch):
            last = max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1)
            yield batch.slice(first, last - first)
            first = last


def lean(function):
    """The function of a task, giving the memory that its batches took back to the system at the end.

    Python workers live on between stages, beside the executor's heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return run


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range, alike wherever it stands; A-Z may count as a-z."""
    keys = _LOWER_KEYS if lower else _BYTE_KEYS
    out = np.zeros(len(start), np.uint64)
    lengths = end - start
    long = lengths > LONG_WORD
    for i in np.flatnonzero(long):
        word = data[start[i]:end[i]]
        word = LOWER[word] if lower else word
        out[i] = int.from_bytes(blake2b(word.tobytes(), digest_size=8).digest(), "little")
    chosen = np.flatnonzero(~long & (lengths > 0))
    total = np.cumsum(lengths[chosen])
    at = 0
    while at < len(chosen):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + PIECE_BYTES, "right")), at + 1)
        rows = chosen[at:to]
        n = lengths[rows]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        weight = _PLACE_KEYS[place & 4095]
        if n.max() > 4096:
            weight = weight + (place >> 12).astype(np.uint64) * _BLOCK_KEY
        terms = keys[data[place + np.repeat(start[rows], n)]] * weight
        out[rows] = np.add.reduceat(terms, begin) ^ (n.astype(np.uint64) * _BLOCK_KEY)
        at = to
    out[~long] = mix(out[~long])
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes; one for every start that has room."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n]
    for k in range(1, size):
        out = combine(out, hashes[k:k + n])
    return out


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Word positions at which a window of ``size`` words lies within one text."""
    n = int(bounds[-1] - bounds[0])
    room = np.ones(n + 1, bool)
    ends = bounds[1:]
    for k in range(1, size):
        at = ends - k
        at = at[at >= bounds[:-1]]
        room[at] = False
    return np.flatnonzero(room[:n])

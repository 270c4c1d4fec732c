"""Vectorised hashing of words and word shingles over Arrow batches.

Everything works on the UTF-8 bytes of a whole batch of texts at once: one
polynomial prefix sum over the bytes gives the hash of any word (or word
prefix) by a subtraction and a multiplication, so no Python object is made per
word.  Null texts count as empty.  Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SHINGLE = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Bytes of text that are hashed in one go; a single longer text goes alone.
SLAB = 1 << 18


def _table(separators: np.ndarray) -> np.ndarray:
    """64 random bits per byte value, upper-case ASCII folded to lower case."""
    rng = np.random.Generator(np.random.PCG64(20240611))
    values = rng.integers(1, _M, 256, np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    values[separators] = 0
    return values


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is no letter parts words; bytes of other scripts don't.
NON_LETTER = np.zeros(256, bool)
NON_LETTER[:128] = True
NON_LETTER[65:91] = NON_LETTER[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers, _inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_P, _P_INV))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: start and end byte, row, and what hashes them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        inside = ~separators[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] |= inside[begins]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[ends] |= inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first_of_row = np.searchsorted(self.start, offsets)
        self.data, self.separators = data, separators
        _grow(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_tables(separators)[data] * _powers[: len(data)], dtype=np.uint64)])

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Of whole words, or of their first `length` bytes (of all where shorter)."""
        end = self.end if length is None else np.minimum(self.end, self.start + length)
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[self.start]) * _inverse[self.start] + np.uint64(0 if length is None else length))


_made: dict[bytes, np.ndarray] = {}


def _tables(separators: np.ndarray) -> np.ndarray:
    key = separators.tobytes()
    if key not in _made:
        _made[key] = _table(separators)
    return _made[key]


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text: every run of `words`
    words; of fewer words the whole sequence; empty without words."""
    for i, j in slabs(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = w.hashes()
        with np.errstate(over="ignore"):
            if len(h) >= words:
                s = sum((h[k : len(h) - words + 1 + k] * _SHINGLE[k] for k in range(words)), np.zeros(len(h) - words + 1, np.uint64))
                s = mix(s)
            else:
                s = h[:0]
            at = w.first_of_row
            for row in range(j - i):
                a, b = at[row], at[row + 1]
                if b - a >= words:
                    yield i + row, np.unique(s[a : b - words + 1])
                elif b > a:
                    yield i + row, mix((h[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
                else:
                    yield i + row, h[:0]

"""Vectorised tokens: NumPy passes over the UTF-8 buffer of an Arrow column.

Work is cut into runs of whole documents of about ``CHUNK`` bytes, so memory
follows the chunk (or the one longest document), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_S = [np.uint64(x) for x in (33, 29, 32)]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _S[0])
        h = h * _M1
        h ^= h >> _S[1]
        h *= _M2
        h ^= h >> _S[2]
    return h


def byte_class(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """A table of 256 booleans: true inside the inclusive ranges (outside if ``inverse``)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return ~out if inverse else out


#: ``[^\x20\x09-\x0D]`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (the latter after lower-casing A-Z).
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), inverse=True)
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]  # A-Z count as a-z

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        m = 1 << max(n - 1, CHUNK).bit_length()
        with np.errstate(over="ignore"):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of whole documents; null counts as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def tokens(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word`` bytes, and each document's first token."""
    w = word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = w[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = w[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token, A-Z folded to a-z: differences of one prefix polynomial."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power(_BASE, len(data))[: len(data)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _power(_INV, len(data) + 1)[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (across documents too; callers cut those)."""
    with np.errstate(over="ignore"):
        m = len(words) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out += words[j : j + m] * np.uint64((_BASE * (2 * j + 1) * (2 * j + 3) | 1) & (2**64 - 1))
        return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5, word: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """Each document's sorted distinct ``n``-word shingles; with fewer words the whole sequence is one."""
    starts, ends, at = tokens(data, offsets, word)
    words = word_hashes(data, starts, ends)
    grams = ngram_hashes(words, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)

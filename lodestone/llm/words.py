"""Vectorised work on the bytes of many texts at once: word bounds, word hashes, five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _fold_case() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


#: Bytes that split words: blank and the five controls 9 to 13.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: A random 64-bit value for each byte, equal for the two cases of A-Z.
BYTE_VALUE = mix(_fold_case().astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i up to n, modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tuple(tables)
    return _powers


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; null reads as empty, a row is never cut."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = in_word[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same for both cases of A-Z."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


SHINGLE = 5
_PLACE = mix(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its five-word shingles); fewer words make one shingle, none make none."""
    for first, data, offsets in text_chunks(texts):
        starts, ends, at = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            grams = mix(sum(words[k : n + k] * _PLACE[k] for k in range(SHINGLE)))
        for i in range(len(offsets) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= SHINGLE:
                yield first + i, np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                short = np.append(words[a:b], np.uint64(b - a)) * _PLACE[[*range(b - a), SHINGLE]]
                yield first + i, mix(np.sum(short, dtype=np.uint64, keepdims=True))
            else:
                yield first + i, np.zeros(0, np.uint64)

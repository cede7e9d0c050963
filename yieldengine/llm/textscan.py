"""Whole-batch text scanning with numpy: word boundaries and 64-bit word fingerprints straight from Arrow buffers.

A batch is cut into pieces of about a quarter of a megabyte (at white space, so that no word is cut); memory follows the piece, not
the batch or the longest document. Fingerprints are polynomial hashes modulo 2^64 over random byte values, finished
with an invertible mixer; they depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Separators of words that leave out ASCII punctuation, and of words of letters only (bytes above 127 count as letters).
PUNCTUATED = SPACE.copy()
PUNCTUATED[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
NOT_LETTER = PUNCTUATED.copy()
NOT_LETTER[:65] = True

_random = np.random.default_rng(20_240_601)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = int(_random.integers(0, 1 << 62)) * 2 + 1
_SLOT = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = _powers(_BASE, 2 * PIECE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), 2 * PIECE)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Power tables for a piece of n bytes; longer than usual only for a single word of over a megabyte."""
    if n <= len(_POW):
        return _POW, _INVERSE
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets


def integers(column: pa.Array) -> list:
    return column.to_pylist()


def pieces(data: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of about PIECE bytes that end at white space (or at `end`)."""
    while start < end:
        stop = min(start + PIECE, end)
        while stop < end:
            back = np.flatnonzero(SPACE[data[start:stop]])
            if len(back):
                stop = start + int(back[-1]) + 1
                break
            stop = min(stop + PIECE, end)
        yield start, stop
        start = stop


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Fingerprints of the byte spans [starts, ends) of `data`."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _tables(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _SLOT[63])


def word_spans(data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators."""
    solid = np.empty(len(data) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~gap[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def document_words(column: pa.Array, lower: bool = True, gap: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each row, in order, the fingerprints of all its words (A-Z lower-cased if asked)."""
    data, offsets = utf8(column)
    row = 0
    while row < len(offsets) - 1:
        first, last = row, row + 1
        while last < len(offsets) - 1 and offsets[last + 1] - offsets[first] <= PIECE:
            last += 1
        row = last
        if last == first + 1:
            parts = [
                span_hashes(data[a:b], *word_spans(data[a:b], gap), lower=lower)
                for a, b in pieces(data, int(offsets[first]), int(offsets[last]))
            ]
            yield np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
            continue
        base = int(offsets[first])
        block = data[base : int(offsets[last])]
        starts, ends = word_spans_of_rows(block, offsets[first : last + 1] - base, gap)
        hashes = span_hashes(block, starts, ends, lower=lower)
        cut = np.searchsorted(starts, offsets[first : last + 1] - base)
        for i in range(last - first):
            yield hashes[cut[i] : cut[i + 1]]


def word_spans_of_rows(block: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word spans of a block of whole rows: a row's end also ends a word."""
    solid = ~gap[block]
    inner = bounds[1:-1]
    before = np.empty(len(block), dtype=bool)
    if len(block):
        before[0] = False
        before[1:] = solid[:-1]
        before[inner[inner < len(block)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(block), dtype=bool)
    if len(block):
        after[-1] = False
        after[:-1] = solid[1:]
        after[inner[inner > 0] - 1] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n successive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + count] * _SLOT[k]
    return mix(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text has its whole word sequence as its one shingle."""
    if not len(words):
        return words
    if len(words) >= n:
        return np.unique(gram_hashes(words, n))
    return mix(gram_hashes(words, len(words)) ^ _SLOT[62 - len(words)])

"""Vectorised word and shingle hashing over Arrow text batches (numpy only, used inside tasks).

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text.  The separators are ASCII, so words can be found on
bytes.  A word's 64-bit hash is a polynomial over random byte values, mixed at the end: two given different
words are equal with a probability near 2^-64, the same for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
SPAN = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, as in splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have[:n]


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, row offsets) of a batch's text column, about max_bytes at a time; null is empty.

    A single text longer than max_bytes makes a chunk of its own: texts are never cut.
    """
    texts = batch.column(column)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the number of words at the end)."""
    inside = ~space[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the number of words at the end).

    Words are hashed some SPAN bytes at a time, so a very long text needs no tables of its length.
    """
    starts, ends, first = word_bounds(data, offsets, space)
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SPAN, "right")))
        if ends[i] - base > SPAN:  # a word beyond the span: piece by piece
            total = 0
            for a in range(base, int(ends[i]), SPAN):
                piece = data[a : min(a + SPAN, int(ends[i]))]
                own = (_BYTE[LOWER[piece] if lower else piece] * _power("up", _BASE, len(piece))).sum()
                total += int(own) * pow(_BASE, a - base, 1 << 64)
            out[i] = total & ((1 << 64) - 1)
        else:
            part = data[base : ends[j - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[LOWER[part] if lower else part] * _power("up", _BASE, len(part)), out=sums[1:])
            at = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[at]) * _power("down", _INVERSE, len(part))[at]
        i = j
    return mix(out), first


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of so many words, by its first word's place; ends earlier than words by length - 1."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for k in range(1, length):
        out += words[k : k + n] * _PLACE[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = 5) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    words, first = word_hashes(data, offsets)
    runs = run_hashes(words, length)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= length:
            own = np.sort(runs[a : b - length + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield mix(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)

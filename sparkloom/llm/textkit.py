"""Vectorised whole-text helpers for Arrow batches: words, 64-bit word hashes and word shingles.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so they equal the runs of such
characters in the decoded text. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 2**63, 5, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def text_chunks(column: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets) over runs of rows of about limit bytes; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        part = data[offsets[first] : offsets[end]]
        yield first, end, (LOWER[part] if lower else part), offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and its row."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~space[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power_table(_BASE, len(buf))[: len(buf)], out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(buf))[starts]
    return mix64(own + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its five-word shingles; a row of one to four words has one."""
    starts, ends, row = word_bounds(buf, offsets)
    words = word_hashes(buf, starts, ends)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    rolled = np.zeros(max(0, len(words) - 4), np.uint64)
    for k in range(5):
        rolled += words[k : len(words) - 4 + k] * _SHINGLE[k] if len(words) > 4 else rolled[:0]
    rolled = mix64(rolled)
    out = []
    for r in range(n_rows):
        a, b = first[r], first[r + 1]
        if b - a >= 5:
            out.append(np.unique(rolled[a : b - 4]))
        elif b > a:
            out.append(mix64((words[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

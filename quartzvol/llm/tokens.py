"""Vectorised word and shingle hashing over Arrow batches of whole texts.

A batch is processed in segments of about a megabyte that are cut only at white
space or between documents, so memory follows the segment and the longest word,
not the batch. All hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, 8, dtype=np.uint64) | _U(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[:1], down[:1] = 1, 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Powers:
    up, down = _powers(1)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(max(n, SEGMENT + 1))
        return cls.up[:n], cls.down[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse."""
    return _Powers.get(n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def _segments(gap: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Cuts of about SEGMENT bytes after a gap byte; a longer word makes a longer cut."""
    at = 0
    while at < n:
        stop = min(at + SEGMENT, n)
        if stop < n:
            back = np.flatnonzero(gap[at:stop])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                ahead = gap[stop:].argmax() if gap[stop:].any() else n - stop
                stop = min(n, stop + int(ahead) + 1)
        yield at, stop
        at = stop


def word_hashes(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each row's words.

    ``gap`` marks the bytes between words and ``fold`` maps bytes before hashing.
    """
    weight = _BYTE[fold]
    is_gap = gap[raw]
    edges = offsets[1:-1]
    hashes, firsts = [], []
    for at, stop in _segments(is_gap, len(raw)):
        part = is_gap[at:stop]
        before = np.empty(len(part), dtype=bool)
        before[0], before[1:] = True, part[:-1]
        after = np.empty(len(part), dtype=bool)
        after[-1], after[:-1] = True, part[1:]
        inner = edges[(edges > at) & (edges < stop)] - at
        before[inner] = True
        after[inner - 1] = True
        inside = ~part
        start = np.flatnonzero(inside & before)
        if not len(start):
            continue
        end = np.flatnonzero(inside & after) + 1
        up, down = _Powers.get(len(part))
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(weight[raw[at:stop]] * up, out=total[1:])
        h = (total[end] - total[start]) * down[start]
        hashes.append(mix(h + (end - start).astype(np.uint64)))
        firsts.append(start + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place; the last n - 1 places run past the end and are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    total = words[:m] * _PLACE[0]
    for k in range(1, n):
        total += words[k : m + k] * _PLACE[k]
    return mix(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; of fewer words the whole sequence is the one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return mix((words * _PLACE[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _U(len(words)))
    return distinct(gram_hashes(words, n))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    values.sort()
    keep = np.empty(len(values), dtype=bool)
    keep[:1] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]

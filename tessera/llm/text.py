"""Vectorised text primitives over Arrow buffers, shared by the Python-backed operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text forms a chunk of its own.
CHUNK = 2 << 20
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_MULT, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _pow, _inv = out
    return _pow[:n], _inv[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, UTF-8 bytes, offsets) of consecutive rows of at most ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def tokens(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes outside ``gap`` (a table of 256); runs never cross rows."""
    word = ~gap[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    last = offsets[1:][offsets[1:] > 0] - 1
    start[first] |= word[first]
    end[last] |= word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def run_starts(x: np.ndarray) -> np.ndarray:
    """Indices at which a sorted array's value changes, the first included."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def sorted_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or the sum of its weights)."""
    if weights is None:
        keys = np.sort(keys)
        at = run_starts(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = run_starts(keys)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights[:0]

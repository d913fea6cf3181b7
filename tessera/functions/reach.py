"""Who reaches whom, within one task: components, strong and undirected, and thin graphs that reach the same.

Plain functions over Arrow arrays of any type that sorts; they hold one chunk of links at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of names that a chunk of links may hold.
BYTES = 256 << 20
DONE = 1 << 62


def strong(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the greatest node of its component, by the links ``u`` to ``v``: Gabow's algorithm without recursion."""
    to = v[np.argsort(u, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(u, minlength=n)).tolist()
    at = [0, *ends[:-1]]
    number, label, count = [0] * n, [0] * n, 0
    met: list[int] = []  # nodes without a component yet
    bounds: list[int] = []  # first nodes of what may be components
    for root in range(n):
        if number[root]:
            continue
        count += 1
        number[root] = count
        met.append(root)
        bounds.append(root)
        path = [root]
        while path:
            x = path[-1]
            for k in range(at[x], ends[x]):
                y = to[k]
                first = number[y]
                if not first:
                    at[x] = k + 1
                    count += 1
                    number[y] = count
                    met.append(y)
                    bounds.append(y)
                    path.append(y)
                    break
                while number[bounds[-1]] > first:
                    bounds.pop()
            else:
                path.pop()
                if bounds[-1] == x:
                    bounds.pop()
                    k = len(met) - 1
                    while met[k] != x:
                        k -= 1
                    members = met[k:]
                    del met[k:]
                    top = max(members)
                    for y in members:
                        number[y], label[y] = DONE, top
    return np.array(label, dtype=np.int64)


def _coded(u: pa.Array, v: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names in order, and both ends of the distinct links as places among them."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[both.indices.to_numpy()]
    key = np.unique(code[: len(u)] * len(order) + code[len(u) :])
    return both.dictionary.take(order), key // max(1, len(order)), key % max(1, len(order))


def thin(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Links by which the same nodes reach each other: each component is a ring in the order of names, links between two components are one; links of a node to itself stay.

    The order makes rings of different chunks alike, so that what they share folds.
    """
    names, a, b = _coded(u, v)
    label = strong(len(names), a, b)
    loops = a[a == b]
    apart = label[a] != label[b]
    between = np.unique(label[a[apart]] * len(names) + label[b[apart]])
    ring = np.argsort(label, kind="stable")  # by component, then by name
    same = label[ring[1:]] == label[ring[:-1]]
    here, there = ring[:-1][same], ring[1:][same]
    first = ring[np.flatnonzero(np.concatenate([[True], ~same]))] if len(ring) else ring
    closing = first[label[first] != first]  # a component's greatest node, its name, goes back to its least
    ends = lambda *parts: names.take(pa.array(np.concatenate(parts)))
    n = max(1, len(names))
    return ends(loops, between // n, here, label[closing]), ends(loops, between % n, there, closing)


def least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node of its component, by the links between ``u`` and ``v`` in either direction."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def joined(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Links from each node to the least one of its component; that one has none to itself unless it is alone."""
    names, a, b = _coded(u, v)
    label = least(len(names), a, b)
    here = np.flatnonzero((label != np.arange(len(names))) | (np.bincount(label, minlength=len(names)) == 1))
    return names.take(pa.array(here)), names.take(pa.array(label[here]))


def _arrays(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(batches)
    return tuple(pa.concat_arrays(table.column(k).chunks) for k in (0, 1))


def thinned(batches: Iterator[pa.RecordBatch], rows: int, thin: Callable[[pa.Array, pa.Array], tuple[pa.Array, pa.Array]] = thin) -> Iterator[pa.RecordBatch]:
    """:func:`thin` (or :func:`joined`) for a stream of links (u, v) without nulls, ``rows`` at a time; what a chunk leaves meets the next one, unless it is more than half of ``rows``."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= BYTES:
            left = pa.RecordBatch.from_arrays(list(thin(*_arrays(held))), schema=batch.schema)
            n, size, held = left.num_rows, left.nbytes, [left]
            if 2 * n > rows or 2 * size > BYTES:
                yield left
                n, size, held = 0, 0, []
    if held:
        yield pa.RecordBatch.from_arrays(list(thin(*_arrays(held))), schema=held[0].schema)


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the components of two or more nodes of all links (u, v) of the stream, named by their greatest node."""
    held = [b for b in batches if b.num_rows]
    if held:
        names, a, b = _coded(*_arrays(held))
        label = strong(len(names), a, b)
        shared = np.flatnonzero(np.bincount(label, minlength=len(names))[label] > 1)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(shared)), names.take(pa.array(label[shared]))], names=["node", "component"])


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all nodes of all links (u, v) of the stream, taken in both directions; components are named by their least node."""
    held = [b for b in batches if b.num_rows]
    if held:
        names, a, b = _coded(*_arrays(held))
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(least(len(names), a, b)))], names=["node", "component"])

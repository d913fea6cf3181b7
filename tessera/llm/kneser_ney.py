"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the workers.

Fitting takes two passes over the training texts. The first counts words by
64-bit hash; a word's id is its rank among the sorted hashes. The second counts
n-grams of the full order by their exact ids, and each further level those of
one word less: an n-gram counts the words that stand before it, so a level's
types, with their first word cut off, are the next one's rows. Tasks combine
counts before every shuffle and send, for each shard, one row of packed columns;
a shard is merged by one task and stored as sorted hash arrays.

An n-gram's shard follows its context, so that the context's totals are at hand
where its n-grams are. Contexts made of hot words only (each more than half a
shard's share of all words, and the begin mark) would fill a shard: their
n-grams are dealt out by the whole n-gram, and their totals are merged by a small
exchange of their own. Shards follow the number of input partitions, so their
size doesn't grow with the input. The driver sees totals and the hot words, of
which there are at most two a shard.

The arrays lie in ``spark.checkpoint.dir``, which must be a mounted (POSIX)
folder of all machines: workers map the files and page in what they look up. Keys
keep 40 bits of a hash within their shard: an n-gram that never occurred is taken
for one that did with a chance of the shard's size over 2**40, about one in a
million, at any size of the corpus. Counting itself goes by ids and is exact.

    P_k(w|v) = max(c(vw) - D_k(c(vw)), 0) / c(v.) + g_k(v) * P_k-1(w|v')
    P_1(w)   = max(N1+(.w) - D_1(..), 0) / N1+(..) + g_1 / (V + 1)

with the three discounts of Chen and Goodman from counts of counts at each level;
v' is v without its first word. A text is preceded by begin marks. Unknown words
have the uniform share only; a level whose context never occurred is left out.

Defined cases: null text is empty, and an empty text is its end token; with no
training rows every probability is 1; a null id is a training row; empty
tables give empty results; repeated rows count each time; texts and vocabularies
may be of any size; columns other than id and text (and those asked to be kept)
are ignored, whatever their names.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialise, shared_path
from .text import chunks, lower_ascii, mix64, run_starts, sorted_counts, span_hash, tokens

#: Words of the longest n-grams.
ORDER = 3
#: The end token's hash.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Tokens that a task gathers before it combines them.
GATHER = 1_000_000
#: Bits of a key within its shard.
KEY = np.uint64(40)
#: The count, or code, that stands for an entry of the overflow arrays.
MORE = 255


def token_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, tokens of each row): words of the lower-cased texts, one end token after each row."""
    for first, data, offsets in chunks(texts):
        data = lower_ascii(data)
        starts, ends, rows = tokens(data, offsets)
        n = len(offsets) - 1
        out = np.full(len(starts) + n, END, np.uint64)
        out[np.arange(len(starts)) + rows] = span_hash(data, starts, ends)
        yield first, out, np.bincount(rows, minlength=n) + 1


def gathered(texts: pa.Array, most: int = GATHER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As :func:`token_hashes`, in larger steps."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    for x in token_hashes(texts):
        held.append(x)
        if sum(len(h) for _, h, _ in held) >= most:
            yield held[0][0], np.concatenate([h for _, h, _ in held]), np.concatenate([c for _, _, c in held])
            held = []
    if held:
        yield held[0][0], np.concatenate([h for _, h, _ in held]), np.concatenate([c for _, _, c in held])


def local(path: str) -> str:
    """The mounted folder of a file: URI."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {path}")
    return path


def save(path: str, **arrays: np.ndarray) -> None:
    """Write arrays so that a repeated task leaves whole files."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    for name, x in arrays.items():
        if name not in ("keys", "k32", "k8") and len(x):
            x = x.astype(np.min_scalar_type(int(x.max())))
        part = f"{path}.{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            np.save(f, x)
        os.replace(part, f"{path}.{name}.npy")


# --- columns of ids ---------------------------------------------------------------------------


def before(ids: np.ndarray, per_row: np.ndarray, d: int, begin: int) -> np.ndarray:
    """The token ``d`` places earlier in its row, or ``begin``."""
    out = np.full_like(ids, begin)
    out[d:] = ids[: len(ids) - d]
    out[np.arange(len(ids)) - np.repeat(np.cumsum(per_row) - per_row, per_row) < d] = begin
    return out


def grams(ids: np.ndarray, per_row: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token."""
    return [before(ids, per_row, d, begin) if d else ids for d in range(order - 1, -1, -1)]


def gram_hash(cols: list[np.ndarray], before: np.ndarray | None = None) -> np.ndarray:
    """64 bits of each row; ``before`` is the hash of the columns that stand before ``cols``."""
    h = np.zeros(len(cols[0]), np.uint64) if before is None else before
    for c in cols:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return h


def key_of(h: np.ndarray) -> np.ndarray:
    """The 40 bits that name an n-gram within a shard, from its hash."""
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> (np.uint64(64) - KEY)


def grouped(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with their summed counts."""
    if not len(counts):
        return cols, counts
    wide = [c.astype(np.uint64) for c in cols]
    if cols[0].dtype == np.uint32:  # two ids a sort key
        wide = [wide[k] << np.uint64(32) | wide[k + 1] if k + 1 < len(wide) else wide[k] for k in range(0, len(wide), 2)]
    order = np.lexsort(wide[::-1]) if len(wide) > 1 else np.argsort(wide[0], kind="stable")
    new = np.zeros(len(counts) - 1, bool)
    for w in wide:
        w = w[order]
        new |= w[1:] != w[:-1]
    at = np.concatenate(([0], np.flatnonzero(new) + 1))
    return [c[order[at]] for c in cols], np.add.reduceat(counts[order].astype(np.int64), at)


def pack(cols: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers as byte planes: equal and neighbouring values compress well."""
    out = [len(cols).to_bytes(1, "little"), len(cols[0]).to_bytes(8, "little")]
    for c in cols:
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        planes = c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [width.to_bytes(1, "little"), np.ascontiguousarray(planes.T).tobytes()]
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    n_cols, n, at, out = body[0], int.from_bytes(body[1:9], "little"), 9, []
    for _ in range(n_cols):
        width = body[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(wide.view("<u8")[:, 0])
        at += 1 + n * width
    return out


# --- the model --------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays are, and the totals; small, and sent with every task."""

    path: str
    shards: int
    order: int = ORDER
    starts: list[int] = field(default_factory=list)  # first id of each vocabulary range
    vocab: int = 0
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids ascending
    types: int = 0  # distinct bigrams
    discounts: dict[int, list[float]] = field(default_factory=dict)  # by level
    gamma1: float = 1.0

    def __post_init__(self):
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def id_type(self) -> type:
        return np.uint32 if self.vocab < (1 << 32) - 2 else np.uint64

    def array(self, kind: str, shard: int, name: str) -> np.ndarray:
        key = f"{kind}-{shard}.{name}.npy"
        if key not in self._open:
            path = f"{self.path}/{key}"
            self._open[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
        return self._open[key].view(np.ndarray)

    def release(self, kind: str, shard: int, *names: str) -> None:
        """Give back the pages that were read, so that a worker holds about one shard at a time."""
        for name in names:
            held = getattr(self._open.get(f"{kind}-{shard}.{name}.npy"), "_mmap", None)
            if held is not None:
                held.madvise(mmap.MADV_DONTNEED)

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)

    def id_shard(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.float64) * self.shards / (self.vocab + 1)).astype(np.int64)

    def bounds(self, shard: int) -> tuple[int, int]:
        """The ids of an id range."""
        ids = np.arange(max(0, shard * (self.vocab + 1) // self.shards - 2), min(self.vocab + 1, (shard + 1) * (self.vocab + 1) // self.shards + 3))
        own = ids[self.id_shard(ids) == shard]
        return (int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0)

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, ids), max(0, len(self.hot) - 1))
        return self.hot[at] == ids if len(self.hot) else np.zeros(len(ids), bool)

    def hot_context(self, cols: list[np.ndarray]) -> np.ndarray:
        """Whether all words of an n-gram's context are hot."""
        out = np.ones(len(cols[0]), bool)
        for c in cols[:-1]:
            out &= self.is_hot(c)
        return out

    def gram_shard(self, cols: list[np.ndarray]) -> np.ndarray:
        before = gram_hash(cols[:-1])
        return self.word_shard(np.where(self.hot_context(cols), gram_hash(cols[-1:], before), before))

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of hashes."""
        u, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        for shard, a, b in slices(self.word_shard(u)):
            keys = self.array("word", shard, "keys")
            at, ok = search(keys, u[a:b])
            ids[a:b][ok] = self.starts[shard] + at[ok]
            counts[a:b][ok] = self.array("word", shard, "counts")[at[ok]]
        return ids[back], counts[back]

    def found(self, kind: str, h: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, rows, places): where the n-grams of the hashes ``h`` stand in the arrays of ``kind``."""
        key = key_of(h)
        order = np.argsort(shard.astype(np.uint64) << KEY | key) if self.shards < 1 << 24 else np.lexsort((key, shard))
        key = key[order]
        q32, q8 = (key >> np.uint64(8)).astype(np.uint32), key.astype(np.uint8)
        for s, a, b in slices(shard[order]):
            k32, k8 = self.array(kind, s, "k32"), self.array(kind, s, "k8")
            if not len(k32):  # nothing of this kind fell into the shard
                continue
            at = np.searchsorted(k32, q32[a:b])
            place, left = np.full(b - a, -1, np.int64), np.arange(b - a)
            while len(left):  # equal upper parts stand side by side
                left = left[at[left] < len(k32)]
                left = left[k32[at[left]] == q32[a:b][left]]
                hit = k8[at[left]] == q8[a:b][left]
                place[left[hit]] = at[left[hit]]
                left = left[~hit]
                at[left] += 1
            ok = np.flatnonzero(place >= 0)
            yield s, order[a:b][ok], place[ok]
            self.release(kind, s, "k32", "k8", "counts", "codes")

    def counts(self, level: int, h: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of n-grams by hash; 0 for those that never occurred."""
        kind, out = f"gram{level}", np.zeros(len(h), np.int64)
        for s, rows, at in self.found(kind, h, shard):
            c = self.array(kind, s, "counts")[at].astype(np.int64)
            big = np.flatnonzero(c == MORE)
            c[big] = self.array(kind, s, "more")[np.searchsorted(self.array(kind, s, "more_at"), at[big])]
            out[rows] = c
        return out

    def _shares(self, level: int, table: np.ndarray) -> np.ndarray:
        """(total, share left to the level below) of rows (total, how many count 1, 2, 3 or more)."""
        table = table.astype(np.float64)
        return np.stack([table[:, 0], table[:, 1:] @ np.array(self.discounts[level]) / np.maximum(table[:, 0], 1)], axis=1)

    def contexts(self, level: int, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the contexts by hash, 0 where one never occurred, and what they leave to the level below."""
        total, rest = np.zeros(len(h)), np.ones(len(h))
        for kind, pick in ((f"context{level}", np.flatnonzero(~hot)), (f"hot{level}", np.flatnonzero(hot))):
            if not len(pick):
                continue
            some = h[pick]
            for s, rows, at in self.found(kind, some, self.word_shard(some)):
                told = self._shares(level, self.array(kind, s, "table"))
                code = self.array(kind, s, "codes")[at].astype(np.int64)
                big = np.flatnonzero(code == MORE)
                code[big] = MORE + np.searchsorted(self.array(kind, s, "more_at"), at[big])
                to = pick[rows]
                total[to], rest[to] = told[code, 0], told[code, 1]
        return total, rest

    def log_probs(self, ids: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        """log10 P of each token after those before it; -1 is unknown."""
        out = np.full(len(ids), self.gamma1 / (self.vocab + 1))
        if not self.vocab:
            return np.log10(out)
        # what goes by single words: a token's own share, and its totals as a context of the next
        total, rest = np.zeros(len(ids)), np.ones(len(ids))
        order = np.argsort(ids, kind="stable")
        order = order[np.searchsorted(ids[order], 0) :]
        for shard, a, b in slices(self.id_shard(ids[order])):
            rows = order[a:b]
            at = ids[rows] - self.bounds(shard)[0]
            c = self.array("cont", shard, "counts")[at].astype(np.int64)
            out[rows] += np.maximum(c - self.cut(c, self.discounts[1]), 0) / max(1, self.types)
            told = self._shares(2, np.stack([self.array("word-context", shard, n)[at] for n in ("total", "n1", "n2", "n3")], axis=1))
            total[rows], rest[rows] = told[:, 0], told[:, 1]
            self.release("word-context", shard, "total", "n1", "n2", "n3")
        first = np.cumsum(per_row) - per_row
        begin = np.full(1, self.vocab)
        shard = int(self.id_shard(begin)[0])
        at = self.vocab - self.bounds(shard)[0]
        told = self._shares(2, np.array([[self.array("word-context", shard, n)[at] for n in ("total", "n1", "n2", "n3")]]))[0]
        shift = lambda x, start: np.concatenate(([start], x[:-1]))
        total, rest = shift(total, told[0]), shift(rest, told[1])
        total[first], rest[first] = told
        place = np.arange(len(ids)) - np.repeat(first, per_row)
        is_hot = self.is_hot(ids)
        for level in range(2, self.order + 1):
            known, hot = np.ones(len(ids), bool), np.ones(len(ids), bool)
            h = np.zeros(len(ids), np.uint64)
            for d in range(level - 1, 0, -1):
                c = np.full(len(ids), self.vocab)
                c[d:] = ids[: len(ids) - d]
                early = place < d
                c[early] = self.vocab
                w = np.ones(len(ids), bool)  # the begin mark is hot
                w[d:] = is_hot[: len(ids) - d]
                hot &= w | early
                known &= c >= 0
                h = gram_hash([c], h)
            if level > 2:
                total, rest = np.zeros(len(ids)), np.ones(len(ids))
                pick = np.flatnonzero(known)
                total[pick], rest[pick] = self.contexts(level, h[pick], hot[pick])
            c = np.zeros(len(ids), np.int64)
            seen = np.flatnonzero((total > 0) & known & (ids >= 0))
            whole = gram_hash([ids[seen]], h[seen])
            c[seen] = self.counts(level, whole, self.word_shard(np.where(hot[seen], whole, h[seen])))
            share = np.maximum(c - self.cut(c, self.discounts[level]), 0) / np.maximum(total, 1)
            out = np.where(known & (total > 0), share + rest * out, out)
        return np.log10(out)

    @staticmethod
    def cut(c: np.ndarray, discount: list[float]) -> np.ndarray:
        return np.array([0.0, *discount])[np.minimum(c, 3)]


def search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted ``wanted`` in sorted ``keys``, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    ok = at < len(keys)
    ok[ok] = keys[at[ok]] == wanted[ok]
    return at, ok


def slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of a sorted array."""
    at = run_starts(shard)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=False):
        yield int(shard[a]), a, b


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of types with counts 1 to 4; plain values where the data give none."""
    plain = [0.5, 1.0, 1.5]
    if not n[0] or not n[1]:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else plain[k - 1] for k in (1, 2, 3)]
    return [d if 0 < d < k else plain[k - 1] for k, d in zip((1, 2, 3), out, strict=True)]


# --- counting ---------------------------------------------------------------------------------

#: kind 0: rows of the next level; 1: totals of hot contexts; 2: sums of the shard.
PACKED = "kind int, shard long, data binary, stats array<long>"


def packed(kind: int, cols: list[np.ndarray], shard: np.ndarray, stats: list[int] | None = None) -> pa.RecordBatch:
    """A row of packed columns for each shard; ``stats`` come as a row of their own."""
    order = np.argsort(shard, kind="stable")
    cut = list(slices(shard[order]))
    rows = [(kind, s, pack([c[order[a:b]] for c in cols]), None) for s, a, b in cut]
    if stats is not None:
        rows.append((2, 0, None, stats))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["kind", "shard", "data", "stats"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))]))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, columns) from packed rows sorted by shard."""
    shard, parts = None, []
    whole = lambda: [np.concatenate(c) for c in zip(*parts, strict=True)]
    for b in batches:
        for s, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            if s != shard and parts:
                yield shard, whole()
                parts = []
            shard = s
            parts.append(unpack(data.as_py()))
    if parts:
        yield shard, whole()


def _counted(columns: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], shard_of: Callable[[list[np.ndarray]], np.ndarray]):
    """A task that turns texts into columns and emits combined counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols, counts = grouped([np.concatenate(c) for c in zip(*[c for c, _ in held], strict=True)], np.concatenate([n for _, n in held]))
            return packed(0, [*cols, counts], shard_of(cols))

        for b in batches:
            for _, h, per_row in gathered(b.column(0)):
                cols = columns(h, per_row)
                held.append(grouped(cols, np.ones(len(cols[0]), np.int64)))
                size += len(held[-1][1])
                if size >= 4 * GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Each shard a task of its own: dealt by number, since a hash of so few keys would unite several."""
    return rows.select("kind", "shard", "data").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")


def save_keyed(path: str, cols: list[np.ndarray], values: np.ndarray) -> None:
    """Arrays in the order of their keys: counts, or with several columns codes into a table of the frequent rows, the others behind it."""
    key = key_of(gram_hash(cols))
    order = np.argsort(key)
    key, values = key[order], values[order]
    keys = {"k32": (key >> np.uint64(8)).astype(np.uint32), "k8": (key & np.uint64(255)).astype(np.uint8)}
    if values.ndim == 1:
        big = np.flatnonzero(values >= MORE)
        save(path, **keys, counts=np.minimum(values, MORE), more_at=big, more=values[big])
        return
    # rows of small numbers, as nearly all are, in one word each
    small = (values < 1 << 16).all(axis=1)
    word = (values[small].astype(np.uint64) << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64)
    told, often = sorted_counts(word)
    kept = np.sort(told[np.argsort(-often, kind="stable")[:MORE]])
    code = np.full(len(values), MORE, np.int64)
    at, ok = search(kept, word)
    code[np.flatnonzero(small)[ok]] = at[ok]
    big = np.flatnonzero(code == MORE)
    table = np.zeros((MORE + len(big), 4), np.int64)
    table[: len(kept)] = (kept[:, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
    table[MORE:] = values[big]
    save(path, **keys, codes=code, more_at=big, table=table)


def _totals(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Contexts of sorted n-grams with (sum, how many count 1, 2, 3 or more)."""
    new = np.zeros(len(counts) - 1, bool)
    for c in cols[:-1]:
        new |= c[1:] != c[:-1]
    at = np.concatenate(([0], np.flatnonzero(new) + 1))
    sums = [np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)]
    return [c[at] for c in cols[:-1]], np.stack(sums, axis=1)


def _levelled(model: Model, level: int):
    """Merge a level's shards: store n-grams and contexts, emit the next level's rows, hot contexts and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in merged(batches):
            cols, counts = grouped([c.astype(model.id_type) for c in parts[:-1]], parts[-1])
            save_keyed(f"{model.path}/gram{level}-{shard}", cols, counts)
            context, sums = _totals(cols, counts)
            if level == 2:  # single words lie by id
                yield packed(1, [*context, *sums.T], model.id_shard(context[0]))
            else:
                hot = model.hot_context([*context, context[0]])
                cold = np.flatnonzero(~hot)
                save_keyed(f"{model.path}/context{level}-{shard}", [c[cold] for c in context], sums[cold])
                if hot.any():
                    pick = [c[hot] for c in context]
                    yield packed(1, [*pick, *sums[hot].T], model.word_shard(gram_hash(pick)))
            rest, n = grouped(cols[1:], np.ones(len(counts), np.int64))
            stats = [len(counts), *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
            yield packed(0, [*rest, n], model.gram_shard(rest) if level > 2 else model.id_shard(rest[0]), stats)

    return run


def _hot_totals(model: Model, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in merged(batches):
            cols = [c.astype(model.id_type) for c in parts[:-4]]
            order = np.lexsort(cols[::-1])
            cols, sums = [c[order] for c in cols], np.stack(parts[-4:], axis=1).astype(np.int64)[order]
            new = np.zeros(len(order) - 1, bool)
            for c in cols:
                new |= c[1:] != c[:-1]
            at = np.concatenate(([0], np.flatnonzero(new) + 1))
            cols, sums = [c[at] for c in cols], np.add.reduceat(sums, at)
            if level == 2:
                low, high = model.bounds(shard)
                dense = np.zeros((4, high - low), np.int64)
                dense[:, cols[0].astype(np.int64) - low] = sums.T
                save(f"{model.path}/word-context-{shard}", **dict(zip(("total", "n1", "n2", "n3"), dense, strict=True)))
            else:
                save_keyed(f"{model.path}/hot{level}-{shard}", cols, sums)
            yield pa.RecordBatch.from_pylist([{"n": len(at)}])

    return run


def fit(train: DataFrame, text_col: str = "text", shards: int | None = None, order: int = ORDER) -> Model:
    """Count ``train`` and store the model; ``shards`` defaults to twice the number of scan partitions."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = train.sparkSession
    texts = train.select(text_col)
    shards = shards or max(8, 2 * texts.rdd.getNumPartitions())
    model = Model(local(shared_path(spark, "kneser-ney")), shards, order)

    rows = _by_shard(texts.mapInArrow(_counted(lambda h, _: [h], lambda c: model.word_shard(c[0])), PACKED), shards)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (h, n) in merged(batches):
            keys, counts = sorted_counts(h, n.astype(np.int64))
            save(f"{model.path}/word-{shard}", keys=keys, counts=counts)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "types": len(keys), "tokens": int(counts.sum())}])

    told = materialise(rows.mapInArrow(words, "shard long, types long, tokens long"), "kneser-ney-words")
    sizes = {r.shard: r for r in told.collect()}
    discard(told)
    for s in range(shards):
        model.starts.append(model.vocab)
        if s in sizes:
            model.vocab += sizes[s].types
            model.tokens += sizes[s].tokens

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                ids = model.starts[s] + np.flatnonzero(model.array("word", s, "counts") > model.tokens / (2 * shards))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])

    model.hot = np.array(sorted([model.vocab, *(r.id for r in spark.range(0, shards, 1, min(shards, 64)).mapInArrow(common, "id long").collect())]), np.int64)

    columns = lambda h, n: [c.astype(model.id_type) for c in grams(model.words(h)[0], n, order, model.vocab)]
    below = texts.mapInArrow(_counted(columns, model.gram_shard), PACKED)
    held = None
    for level in range(order, 1, -1):
        found = materialise(_by_shard(below, shards).mapInArrow(_levelled(model, level), PACKED), "kneser-ney-level")
        discard(held)
        sums = found.where("kind = 2").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(5)]).first()
        model.types, model.discounts[level] = sums[0], discounts(sums[1:])
        _by_shard(found.where("kind = 1"), shards).mapInArrow(_hot_totals(model, level), "n long").agg(F.sum("n")).first()
        below, held = found.where("kind = 0"), found

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (w, n) in merged(batches):
            low, high = model.bounds(shard)
            ids, counts = sorted_counts(w.astype(np.int64), n.astype(np.int64))
            dense = np.zeros(high - low, np.int64)
            dense[ids - low] = counts
            save(f"{model.path}/cont-{shard}", counts=dense)
            of = np.bincount(np.minimum(counts, 5), minlength=6)
            yield pa.RecordBatch.from_pylist([{"n": of[1:5].tolist(), "more": int(of[5])}])

    rows = _by_shard(below, shards).mapInArrow(continuations, "n array<long>, more long")
    sums = rows.agg(*[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(4)], F.coalesce(F.sum("more"), F.lit(0))).first()
    discard(held)
    model.discounts[1] = d = discounts(sums[:4])
    if model.types:
        model.gamma1 = (d[0] * sums[0] + d[1] * sums[1] + d[2] * (sums[2] + sums[3] + sums[4])) / model.types
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, kept columns, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row."""
    head = [id_col, *keep]
    rest = T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    schema = T.StructType([*(docs.schema[c] for c in head), *rest.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, per_row in gathered(b.column(len(head))):
                ids, counts = model.words(h)
                at = np.cumsum(per_row) - per_row
                base = np.add.reduceat(np.log10((counts + 1) / (model.tokens + model.vocab + 1)), at)
                known = np.add.reduceat((counts > 0).astype(np.int64), at)
                total = np.add.reduceat(model.log_probs(ids, per_row), at)
                n = len(per_row)
                part = b.slice(first, n)
                data = [per_row, known, np.full(n, model.tokens), base, total, 10 ** np.minimum(300, -total / per_row)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(head)], *map(pa.array, data)], names=schema.names)

    return docs.select(*head, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model doesn't learn from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row."""
    docs = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    model = fit(docs.where("not held_out"), text_col, order=order)
    return score(docs, model, id_col, text_col, "held_out")

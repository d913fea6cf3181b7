"""SimHash near-duplicate detection with bit-sliced fingerprint comparison.

Fingerprints (64 bits) come from the XXH64 values of word shingles. Two
fingerprints link at ``radius`` or fewer differing bits; components of links
are near-duplicate groups.

Search: equal fingerprints form one class. For classes, a pigeonhole scheme
cuts the 64 bits into blocks such that linked fingerprints agree on at least
``match`` whole blocks; each (table, key) bucket is compared inside one task.
There the bits stand as vertical planes, distances grow by a carry-save
counter over many pairs at once, and a pivot row is abandoned as soon as all
of its lanes exceed the radius. Tasks emit a spanning set of links only.

:func:`similar_groups` joins documents beyond the radius by the exact Jaccard
similarity of their five-word shingle sets. Candidates come from a prefix filter,
which loses no pair at the similarity asked for; pairs are compared inside tasks,
by sizes and parity bits first, and leave them only as links that join.

Defined cases: null or word-less text has fingerprint zero and links like any
other; equal texts share a class; texts of any length are whole; repeated rows
are rows of their own; a component is named by its least id, null only if it has
no other; an empty table gives an empty result; extra columns are ignored,
whatever their names (:func:`representatives` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import discard, materialise, tidy
from .text import chunks, lower_ascii, mix64, span_hash, tokens

SEED = 42
#: Rows of a bucket that one task compares with themselves; larger buckets are dealt out as pairs of parts.
PART = 16_384
#: Rows of small buckets that are compared together.
BLOCK = 256


# --- fingerprints -----------------------------------------------------------------------------


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Majority fingerprint of each text's word shingles (repeats count)."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, data, offsets in chunks(texts):
        data = lower_ascii(data)
        starts, ends, rows = tokens(data, offsets)
        if not len(starts):
            continue
        # words joined by one space each, rows one after the other
        sizes = ends - starts
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        joined = np.full(at[-1], 32, np.uint8)
        src = np.arange(at[-1]) - np.repeat(at[:-1] - starts, sizes + 1)
        inside = np.arange(at[-1]) - np.repeat(at[:-1], sizes + 1) < np.repeat(sizes, sizes + 1)
        joined[inside] = data[src[inside]]
        body = joined.tobytes()
        a, b = at[:-1], at[1:] - 1
        n_words = np.bincount(rows, minlength=len(offsets) - 1)
        begin = np.cumsum(n_words) - n_words
        take = np.minimum(shingle, n_words)  # a shorter text is one shingle
        place = np.arange(len(starts)) - begin[rows]
        heads = np.flatnonzero(place <= (n_words - take)[rows])
        tails = heads + take[rows[heads]] - 1
        h = np.fromiter((digest(body[x:y], SEED) for x, y in zip(a[heads].tolist(), b[tails].tolist(), strict=True)), np.uint64, len(heads))
        per_row = np.bincount(rows[heads], minlength=len(offsets) - 1)
        out[first : first + len(per_row)] = majority(h, per_row)
    return out


def majority(h: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Bits set in over half of each row's consecutive hashes; rows without hashes give zero."""
    out = np.zeros(len(per_row), np.uint64)
    full = np.flatnonzero(per_row)
    if not len(full):
        return out
    at = np.cumsum(per_row) - per_row
    for lo in range(0, len(full)):
        r = full[lo]
        x = h[at[r] : at[r] + per_row[r]]
        n = len(x)
        if n == 1:
            out[r] = x[0]
            continue
        ones = np.zeros(64, np.int64)
        for s in range(0, n, 8192):
            part = x[s : s + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the signed 64-bit pattern of each document's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- bit-sliced comparison --------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit b of fingerprint i stands in plane b, word i // 64, bit i % 64."""
    pad = -len(fps) % 64
    bits = np.unpackbits(np.append(fps, np.zeros(pad, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(pivots: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, row) indices of all pairs at ``radius`` or fewer differing bits.

    ``sliced``: the planes of ``n`` rows. Every plane adds one bit to the
    carry-save counters of 64 pairs per word; after each 8 planes, pivots all
    of whose lanes have passed the radius are abandoned.
    """
    words = sliced.shape[1]
    width = max(1, int(radius).bit_length())
    lanes = np.full(words, ~np.uint64(0), np.uint64)
    if n % 64:
        lanes[-1] = np.uint64((1 << (n % 64)) - 1)
    alive = np.arange(len(pivots))
    count = [np.zeros((len(pivots), words), np.uint64) for _ in range(width)]
    over = np.broadcast_to(~lanes, (len(pivots), words)).copy()
    for p in range(64):
        flip = (np.uint64(0) - ((pivots[alive] >> np.uint64(p)) & np.uint64(1)))[:, None]
        carry = flip ^ sliced[p][None, :]
        for c in count:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if p % 8 == 7:
            if radius + 1 != 1 << width:  # counters can hold more than the radius: compare
                over |= _above(count, radius)
            live = (~over).any(axis=1)
            if not live.all():
                alive, over = alive[live], over[live]
                count = [c[live] for c in count]
                if not len(alive):
                    break
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(alive), -1), axis=1, bitorder="little")[:, :n]
    i, j = np.nonzero(ok)
    return alive[i], j


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter exceeds ``radius``."""
    above = np.zeros_like(count[0])
    same = ~above
    for b in range(len(count) - 1, -1, -1):
        if radius >> b & 1:
            same = same & count[b]
        else:
            above |= same & count[b]
            same = same & ~count[b]
    return above


def links_in(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of links among distinct fingerprints: a search in waves over the rows not yet reached."""
    links: list[tuple[int, int]] = []
    left = fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        sliced = planes(left)
        while len(front) and len(left):
            step = max(1, (1 << 18) // max(1, sliced.shape[1]))  # bounds the counters' memory
            wave, front = front[:step], front[step:]
            i, j = within(wave, sliced, len(left), radius)
            if not len(j):
                continue
            rows, at = np.unique(j, return_index=True)
            links += zip(wave[i[at]].tolist(), left[rows].tolist(), strict=True)
            front = np.append(front, left[rows])
            left = np.delete(left, rows)
            sliced = planes(left)
    return links


def small_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """All links inside one block of a few hundred rows, reduced to a forest of the shortest."""
    i, j = within(fps, planes(fps), len(fps), radius)
    keep = i < j
    i, j = i[keep], j[keep]
    order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable")
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            root[q] = p
            out.append((int(fps[x]), int(fps[y])))
    return out


# --- candidate buckets ------------------------------------------------------------------------


def scheme(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (shift, width) of each table's key for ``n`` distinct fingerprints.

    ``radius`` flipped bits spoil at most ``radius`` of ``radius + match`` blocks,
    so some ``match`` whole blocks agree. More data takes longer keys.
    """
    match = 1 if n <= 1 << 22 else 2 if n <= 1 << 30 else 3
    blocks = radius + match
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    ranges = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(blocks)]
    return [list(c) for c in combinations(ranges, match)]


def _key(fp, ranges: list[tuple[int, int]]):
    key = None
    for shift, width in ranges:
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        key = part if key is None else F.shiftleft(key, width).bitwiseOR(part)
    return key


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows sorted by (t, key, a, b): group starts and fingerprints, cut at group ends only."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = np.ones(len(cols[0]) - 1, bool)
        for k in range(4):
            same &= cols[k][1:] == cols[k][:-1]
        cut = np.flatnonzero(~same)
        if not len(cut):
            rest = cols
            continue
        at = cut[-1] + 1
        yield _groups([c[:at] for c in cols])
        rest = [c[at:] for c in cols]
    if rest is not None and len(rest[0]):
        yield _groups(rest)


def _groups(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    same = np.ones(len(cols[0]) - 1, bool)
    for k in range(4):
        same &= cols[k][1:] == cols[k][:-1]
    return np.flatnonzero(np.concatenate(([True], ~same))), cols[4].view(np.uint64)


def _compare(radius: int):
    """A spanning set of the links within ``radius``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, fps in _grouped(batches):
            sizes = np.diff(np.append(starts, len(fps)))
            links: list[tuple[int, int]] = []
            small = np.flatnonzero((sizes > 1) & (sizes <= BLOCK))
            block: list[np.ndarray] = []
            held = 0
            for g in small.tolist():
                if held + sizes[g] > BLOCK and held:
                    links += small_links(np.unique(np.concatenate(block)), radius)
                    block, held = [], 0
                block.append(fps[starts[g] : starts[g] + sizes[g]])
                held += sizes[g]
            if block:
                links += small_links(np.unique(np.concatenate(block)), radius)
            for g in np.flatnonzero(sizes > BLOCK).tolist():
                links += links_in(np.unique(fps[starts[g] : starts[g] + sizes[g]]), radius)
            if links:
                pair = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["src", "dst"])

    return run


def fingerprint_links(fps: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(src, dst): links that span every component of the distinct ``fp`` values, none lost.

    Buckets of over ``PART`` rows are cut into parts by hash, and each pair of
    parts is a task of its own, so a hot bucket spreads over the cluster.
    """
    tables = scheme(n, radius)
    keyed = fps.select("fp", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), _key(F.col("fp"), r).alias("key")) for t, r in enumerate(tables)])))
    return _bucket_links(keyed, radius)


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(src, dst) from rows (fp, t, key)."""
    sizes = keyed.groupBy("t", "key").count().where(F.col("count") > 1)
    parts = F.ceil(F.col("count") / PART).cast("int")
    return _dealt_links(keyed.join(sizes.select("t", "key", parts.alias("parts")), ["t", "key"]), radius)


def _dealt_links(rows: DataFrame, radius: int) -> DataFrame:
    """(src, dst) from rows (fp, t, key, parts)."""
    own = F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    dealt = rows.withColumn("own", own).select("t", "key", "fp", "own", F.explode(others).alias("other")).select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    order = ["t", "key", "a", "b"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(radius), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id): the smallest id reachable over links, one row for each row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-classes")
    links = fingerprint_links(classes, classes.count(), radius)
    groups = connected_components(links)  # (node, component)
    named = classes.join(groups, classes.fp == groups.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    to = named.join(least, "component").select("fp", "component_id")
    return prints.join(to, "fp").select(id_col, "fp", "component_id")


# --- verified similarity ----------------------------------------------------------------------

#: Rows that a broadcast may hold (32 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Shingles known to be frequent (they come last in the common order), and documents that are counted for them at most.
FREQUENT, COUNTED = 200_000, 1_000_000
#: Buckets whose key leaves 0 by this are compared first, so that most groups are joined before the others are.
FIRST = 16
#: Rows, and shingles, of a bucket that one task compares with themselves; larger buckets are dealt out as pairs of parts.
ROWS, SHINGLES = 4096, 2_000_000


def shingle_sets_of(texts: pa.Array, shingle: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle, none without words."""
    for _, data, offsets in chunks(texts):
        data = lower_ascii(data)
        starts, ends, rows = tokens(data, offsets)
        h = span_hash(data, starts, ends)
        n_words = np.bincount(rows, minlength=len(offsets) - 1)
        begin = np.cumsum(n_words) - n_words
        take = np.minimum(shingle, n_words)
        heads = np.flatnonzero(np.arange(len(starts)) - begin[rows] <= (n_words - take)[rows])
        of = take[rows[heads]]
        out = np.zeros(len(heads), np.uint64)
        for k in range(shingle):
            more = np.flatnonzero(of > k)
            out[more] = mix64(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[heads[more] + k])
        at = np.searchsorted(rows[heads], np.arange(len(offsets)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(out[a:b])


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), flat)


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [x.view(np.int64) for x in shingle_sets_of(part.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(sets)], names=["uid", "s"])

    return run


def frequent(docs: DataFrame, n: int, shingle: int = 5, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of the most frequent shingles of a sample; any list gives right results, a good one short buckets."""
    every = max(1, min(16, n // 20_000), n // COUNTED)
    some = docs.select(F.lit(0).alias("uid"), text_col).where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0)
    sets = some.mapInArrow(_shingle_sets(shingle), "uid int, s array<long>")
    counts = sets.select(F.explode("s").alias("h")).groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT)
    top = counts.toArrow().sort_by("h")
    return top["h"].to_numpy(), top["count"].to_numpy()


def parity(h: np.ndarray, n: int) -> bytes:
    """A bit for each residue class of the hashes, set if an odd number of them fall there; 64 bits or a power of two of ``n`` or more."""
    size = 64 if n <= 64 else 1 << min(20, (n - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _profiles(base: int, shingle: int, similarity: float, hot: np.ndarray, counts: np.ndarray, names: list[str]):
    """For each row its fingerprint, the key of its shingle set (128 bits), the set's size, the prefix in the common order (rare first; the frequent ones apart), and the parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                fp = fingerprints_of(b.column(3), base)
                keys, sizes, rare, often, bits = [], [], [], [], []
                for x in shingle_sets_of(b.column(3), shingle):
                    h = x.view(np.int64)
                    weight = np.zeros(len(h), np.int64)
                    if len(hot) and len(h):
                        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                        weight = np.where(hot[at] == h, counts[at], 0)
                    k = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                    order = np.lexsort((h, weight))[:k]
                    keys.append(xxhash.xxh3_128_intdigest(x.tobytes()))
                    sizes.append(len(h))
                    rare.append(h[order[weight[order] == 0]])
                    often.append(h[order[weight[order] > 0]])
                    bits.append(parity(x, len(x)))
                halves = np.array([(k >> 64, k & (1 << 64) - 1) for k in keys], np.uint64).reshape(-1, 2).view(np.int64)
                made = [fp.view(np.int64), np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), np.array(sizes, np.int32)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, made), lists(rare), lists(often), pa.array(bits, pa.binary())], names=names)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut at the ends of groups (runs of equal first ``keys`` columns), with the groups' bounds."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def cuts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(0, b.num_rows - 1), bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            new |= x[1:] != x[:-1]
        return np.flatnonzero(new) + 1

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if rest and all(rest[-1].column(k)[-1] == b.column(k)[0] == b.column(k)[-1] for k in range(keys)):
            rest.append(b)
            continue
        b = joined([*rest, b])
        at = cuts(b)
        if len(at):
            yield b.slice(0, at[-1]), np.concatenate(([0], at))
            rest = [b.slice(at[-1])]
        else:
            rest = [b]
    if rest:
        b = joined(rest)
        yield b, np.concatenate(([0], cuts(b), [b.num_rows]))


class Bucket:
    """Rows of one bucket: which may be similar, by sizes and parity bits.

    Two sets of similarity t differ in at most (1 - t) / (1 + t) of their summed
    sizes, and their parity bits in no more places than that.
    """

    def __init__(self, sizes: np.ndarray, bits: list[bytes], similarity: float):
        self.n, self.similarity = sizes, similarity
        wide = np.array([len(x) // 8 for x in bits])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.of: list[tuple[int, int]] = [(0, 0)] * len(bits)
        for w in np.unique(wide).tolist():
            same, twice = np.flatnonzero(wide == w), np.flatnonzero(wide == 2 * w)
            read = lambda rows, k: np.frombuffer(b"".join(bits[r] for r in rows), np.uint64).reshape(len(rows), k)
            double = read(twice, 2 * w)
            self.tables[w] = np.concatenate((same, twice)), np.concatenate((read(same, w), double[:, :w] ^ double[:, w:]))
            for k, r in enumerate(same.tolist()):
                self.of[r] = w, k

    def partners(self, i: int) -> np.ndarray:
        """Rows that may be similar to row ``i``; over all rows, each pair comes once."""
        w, k = self.of[i]
        rows, table = self.tables[w]
        rest, own = rows[k + 1 :], table[k + 1 :]
        bound = (1 - self.similarity) / (1 + self.similarity) * (self.n[i] + self.n[rest]) + 1e-9
        fit = np.flatnonzero(np.abs(self.n[i] - self.n[rest]) <= bound)
        apart = np.bitwise_count(own[fit] ^ table[k]).sum(axis=1, dtype=np.int64)
        return rest[fit[apart <= bound[fit]]]


def _possible(similarity: float):
    """(h, uid) of the rows that may be similar to a row of another component in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cut in _whole_groups(batches, 3):
            h, uid, n, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 3, 4, 5))
            bits = b.column(6).to_pylist()
            found: list[int] = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2 or (c[lo:hi] == c[lo]).all():
                    continue
                bucket, mark = Bucket(n[lo:hi].astype(np.int64), bits[lo:hi], similarity), np.zeros(hi - lo, bool)
                for i in range(hi - lo):
                    j = bucket.partners(i)
                    j = j[c[lo + j] != c[lo + i]]
                    mark[j] = True
                    mark[i] |= len(j) > 0
                found += (lo + np.flatnonzero(mark)).tolist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(h[found]), pa.array(uid[found])], names=["h", "uid"])

    return run


def _similar(similarity: float):
    """(src, dst): verified pairs that join each bucket's components as far as they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cut in _whole_groups(batches, 3):
            uid, n, c = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            links: list[tuple[int, int]] = []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                part = b.slice(lo, hi - lo)
                sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in part.column(7)]
                bucket, label = Bucket(n[lo:hi].astype(np.int64), part.column(6).to_pylist(), similarity), c[lo:hi].copy()
                for i in range(hi - lo):
                    for j in bucket.partners(i).tolist():
                        if label[i] == label[j]:
                            continue
                        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if common + 1e-9 >= similarity * (len(sets[i]) + len(sets[j]) - common):
                            links.append((int(uid[lo + i]), int(uid[lo + j])))
                            label[label == label[j]] = label[i]
            if links:
                pair = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], names=["src", "dst"])

    return run


def _dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (h, uid, ...) of the buckets in ``parts`` (h, parts), sorted by (h, a, b): each pair of a bucket's parts stands together."""
    own = F.pmod(F.xxhash64("uid", "h"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))
    dealt = rows.join(parts, "h").withColumn("own", own)
    rest = [c for c in rows.columns if c != "h"]
    dealt = dealt.select("h", *rest, "own", F.explode(others).alias("other")).select("h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *rest)
    return dealt.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b")


def _row_keys(id_col: str, text_col: str) -> list:
    """128 bits that name a row by id and text."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(7), text_col, id_col).alias("k2")]


def _labelled(uids: DataFrame, links: DataFrame) -> DataFrame:
    """``uids`` with c: the least uid reachable over ``links``."""
    group = connected_components(links)
    return uids.join(group.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("c", F.coalesce("component", "uid")).drop("component")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3, base: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, component_id, first): one row for each row of ``docs``.

    Groups are the components of fingerprints (of ``base`` words) within
    ``radius``, and of sets of ``shingle`` words with a Jaccard similarity of
    ``similarity`` or more. ``component_id`` is the least id of the group; k1 and
    k2 name a row by id and text, and ``first`` holds for the rows of one such
    name in each group: the least by (id, k1, k2), null ids last.

    Equal sets are one class. Of two similar sets, the shorter one's size is
    bounded by the longer one's, and they share a shingle of their prefixes (the
    rarest 1 - ``similarity`` of each, and one more), so they meet in its bucket.
    There sizes and parity bits rule out nearly all pairs, in blocks inside a
    task; only rows that are left bring their sets, and only where they belong
    to different components. No pair leaves a task but for the links that join.
    """
    kind = docs.schema[id_col].dataType
    keyed = docs.select(*_row_keys(id_col, text_col), id_col, text_col)
    hot, counts = frequent(docs.select(text_col), docs.count(), shingle, text_col)
    longs, array = T.LongType(), T.ArrayType(T.LongType())
    kinds = {"k1": longs, "k2": longs, id_col: kind, "fp": longs, "ka": longs, "kb": longs, "n": T.IntegerType(), "p": array, "q": array, "bits": T.BinaryType()}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    made = keyed.mapInArrow(_profiles(base, shingle, similarity, hot, counts, schema.names), schema)
    rows = materialise(made.withColumn("uid", F.monotonically_increasing_id()), "similar-rows")

    # rows are linked with the first row of their fingerprint and of their class, and the first rows of fingerprints among each other
    prints = materialise(rows.groupBy("fp").agg(F.min("uid").alias("rep")), "similar-prints")
    classes = materialise(rows.where("n > 0").groupBy("ka", "kb").agg(F.min("uid").alias("rep")), "similar-classes")
    near = fingerprint_links(prints.select("fp"), prints.count(), radius)
    for end in ("src", "dst"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_rep")), end).drop(end).withColumnRenamed(f"{end}_rep", end)
    links = rows.select("uid", "fp").join(prints, "fp").select(F.col("uid").alias("src"), F.col("rep").alias("dst"))
    links = links.unionByName(rows.where("n > 0").select("uid", "ka", "kb").join(classes, ["ka", "kb"]).select(F.col("uid").alias("src"), F.col("rep").alias("dst")))
    links = materialise(links.where("src != dst").unionByName(near).distinct(), "similar-links")

    sets = materialise(rows.where("n > 0").join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select("uid", "k1", "k2", "n", "p", "q", "bits"), "similar-sets")
    tidy(docs.sparkSession)
    met = materialise(_alone_dropped(sets.select("uid", F.explode("p").alias("h"))).unionByName(sets.select("uid", F.explode("q").alias("h"))), "similar-met")
    for share in (F.pmod("h", F.lit(FIRST)) == 0, F.lit(True)):
        labels = materialise(_labelled(sets.select("uid"), links), "similar-labels")
        told = met.where(share).join(labels, "uid")
        sign = F.expr("bit_xor(xxhash64(uid, 1))").alias("s1"), F.expr("bit_xor(xxhash64(uid, 2))").alias("s2")
        sizes = told.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), *sign).where("lo != hi")
        # buckets with the same rows are compared once
        once = sizes.groupBy("m", "s1", "s2").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("m") / ROWS).cast("int").alias("parts"))
        once = materialise(once, "similar-buckets")
        told = told.join(once.select("h"), "h", "left_semi").join(sets.select("uid", "n", "bits"), "uid").select("h", "uid", "n", "c", "bits")
        possible = materialise(_dealt(told, once).mapInArrow(_possible(similarity), "h long, uid long").distinct(), "similar-possible")
        wanted = materialise(possible.select("uid").distinct().join(sets.select("uid", "k1", "k2"), "uid"), "similar-wanted")
        small = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
        # the second half of the name as a plain condition: a table by one long is a fraction of one by two
        texts = keyed.join(small.withColumnRenamed("k2", "_k2"), "k1").where(F.col("k2").bitwiseXOR(F.col("_k2")) == 0).select("uid", text_col)
        shingles = texts.mapInArrow(_shingle_sets(shingle), "uid long, s array<long>").groupBy("uid").agg(F.first("s").alias("s"))
        shingles = materialise(shingles, "similar-shingles")
        here = possible.join(labels, "uid").join(sets.select("uid", "n", "bits"), "uid")
        parts = here.groupBy("h").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / ROWS)).cast("int").alias("parts"))
        found = _dealt(here.join(shingles, "uid").select("h", "uid", "n", "c", "bits", "s"), parts).mapInArrow(_similar(similarity), "src long, dst long")
        both = labels.select(F.col("uid").alias("src"), F.col("c").alias("dst")).where("src != dst").unionByName(found)
        grown = materialise(both.unionByName(links).distinct(), "similar-links")
        discard(links, labels, once, possible, wanted, shingles)
        tidy(docs.sparkSession)
        links = grown
    discard(met, sets)
    told = materialise(_labelled(rows.select("uid", "k1", "k2", id_col), links).drop("uid"), "similar-groups")
    discard(links, rows, prints, classes)
    name = F.struct(F.col(id_col).isNull().alias("none"), id_col, "k1", "k2")
    best = told.groupBy("c").agg(F.min(name).alias("least"))
    return told.join(best, "c").select(id_col, "k1", "k2", F.col("least")[id_col].alias("component_id"), ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))).alias("first"))


def _alone_dropped(rows: DataFrame) -> DataFrame:
    """``rows`` (uid, h) without those whose ``h`` no other row has; none of them is frequent, so that keys are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last row, and whether the one before has its key
        shared = False
        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            h = b.column(1).to_numpy(zero_copy_only=False)
            same = h[1:] == h[:-1]
            keep = np.concatenate(([shared], same)) | np.concatenate((same, [False]))
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
            rest, shared = b.slice(b.num_rows - 1), bool(keep[-1])
        if rest is not None and shared:
            yield rest

    return rows.select("uid", "h").repartition("h").sortWithinPartitions("h").mapInArrow(run, "uid long, h long")


def representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each of the :func:`similar_groups`: its first. Of rows with equal id and text, the one least by its other columns stays."""
    groups = similar_groups(docs, similarity, shingle, radius, 3, id_col, text_col)
    first = materialise(groups.where("first").groupBy("k1", "k2").agg(F.count("*").alias("_copies")), "similar-first")
    named = docs.select("*", *[c.alias(f"_{n}") for n, c in zip(("k1", "k2"), _row_keys(id_col, text_col), strict=True)])
    kept = named.join(first, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
    more = kept.where("_copies > 1").groupBy("_k1", "_k2").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return kept.where("_copies = 1").select(*docs.columns).unionByName(more)

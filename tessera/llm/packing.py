"""Lexical retrieval packing of token ids into fixed windows.

Three passes. The first turns texts into ids, written to the shared folder, and
counts the documents of each id. The second gives each document a lexical
sketch: the ids that win two exponential races at the speed of their inverse
document frequency, so two documents share a winner with a chance equal to
their weighted Jaccard similarity. A range exchange by sketch then brings
documents with rare ids in common together, wherever they stood; rows with the
same sketch are told apart by a salt, so a hot one spreads over ranges.

Every task of the third pass packs its range: it gathers shards of about
``shard_tokens`` ids, builds a BM25 inverted index over each shard's documents
and lets every seed document call its best unused neighbours by all ids it
shares with others; they fill the seed's window greedily. The last neighbour of
a window is cut to fit and its rest stays in the shard. What is left when a
shard runs dry is cut into sequences whose lengths are powers of two, so no
sequence holds padding. Memory is bounded by ``shard_tokens`` and the longest
text; the driver sees one count for each id of the vocabulary.

Ids: byte-level BPE from a ``tokenizers`` JSON file, then ``end_id``. The file is
read once on the driver and sent along. Its merges run on tiktoken's merger,
which gives equal ids several times as fast (tests hold the two together);
texts that spell out an added token, texts that the merger refuses and files of
another make go to ``tokenizers``.

Defined cases: null text is empty and yields just ``end_id``; equal texts are
documents of their own; very long texts are cut into whole windows and a tail;
ties in score go to the earlier row of the range; empty tables give empty
results; added tokens spelled out in a text become their ids, as in the
library; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialise
from .text import mix64, run_starts

K1, B = 1.2, 0.75


def size_of(told: dict) -> int:
    """One more than the greatest id of a parsed file."""
    return max([*told["model"]["vocab"].values(), *(t["id"] for t in told.get("added_tokens", []))]) + 1


class ByteBpe:
    """Ids of texts under a byte-level BPE ``tokenizers`` file, given as its JSON text."""

    def __init__(self, spec: str):
        self.spec, self._slow = spec, None
        told = json.loads(spec)
        vocab, self.added = told["model"]["vocab"], {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.size = size_of(told)
        before, plain = told.get("pre_tokenizer") or {}, ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self._fast = self._merger(told["model"]) if usual and told.get("normalizer") is None and not any(told["model"].get(k) for k in plain) else None

    def _merger(self, model: dict):
        """The merges as tiktoken ranks, and the ids of the ranks."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [*byte_of, *joined]
        if len(set(order)) < len(order) or any(t not in model["vocab"] for t in order):
            return None  # ranks couldn't tell the merges apart
        # how the library's byte-level step splits a text
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._id = np.array([model["vocab"][t] for t in order], np.uint32)
        self._same = bool((self._id == np.arange(len(order))).all())
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks={bytes(byte_of[c] for c in t): k for k, t in enumerate(order)}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is None or any(t in text for t in self.added):
            return self.reference(text)
        try:
            ids = np.frombuffer(array("I", self._fast.encode_ordinary(text)), np.uint32)
            return ids if self._same else self._id[ids]
        except ValueError:  # its pattern engine gives up on some huge runs
            return self.reference(text)

    def reference(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.spec)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def loaded(packed: bytes) -> ByteBpe:
    """The tokenizer of a compressed file, once a worker."""
    return ByteBpe(zlib.decompress(packed).decode())


class Shard:
    """A BM25 inverted index over documents; a document leaves when it is used."""

    def __init__(self, docs: list[np.ndarray], vocab: int):
        n = len(docs)
        sizes = np.array([len(p) for p in docs], np.int64)
        term = np.concatenate(docs).astype(np.int64)
        key = np.sort(term * n + np.repeat(np.arange(n), sizes))
        at = run_starts(key)
        tf = np.diff(np.append(at, len(key)))
        term, self.docs = np.divmod(key[at], n)
        self.ptr = np.searchsorted(term, np.arange(vocab + 1))
        df = np.diff(self.ptr)
        idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))  # a term of over half the documents tells nothing
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        self.impact = idf[term] * tf * (K1 + 1) / (tf + norm[self.docs])
        # each document's terms that another one has too, and that weigh something
        shared = np.flatnonzero((df[term] > 1) & (idf[term] > 0))
        order = shared[np.argsort(self.docs[shared], kind="stable")]
        self.query_terms, owner = term[order], self.docs[order]
        self.query_ptr = np.searchsorted(owner, np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        terms = self.query_terms[self.query_ptr[seed] : self.query_ptr[seed + 1]]
        first, sizes = self.ptr[terms], self.ptr[terms + 1] - self.ptr[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], self.impact[at], self.n)

    def best(self, seed: int, used: np.ndarray, first: int = 32) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; only the ``first`` ones are put in order unless more are asked for."""
        score = self.scores(seed)
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > 4 * first:
            least = np.partition(score[found], len(found) - first)[len(found) - first]
            top = found[score[found] >= least]
            yield from top[np.argsort(-score[top], kind="stable")].tolist()
            found = found[score[found] < least]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_shard(sizes: list[int], docs: list[np.ndarray], window: int, vocab: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (row, start in its piece, length, sequence, offset) for pieces shorter than a window, ``docs`` being what they are looked up by."""
    if not docs:
        return
    index = Shard(docs, vocab)
    n, start = len(docs), [0] * len(docs)
    left = list(sizes)
    used = np.zeros(n, bool)
    sequence = seed = 0
    while True:
        while seed < n and used[seed]:
            seed += 1
        if seed == n:
            return
        room, row, taken = window, seed, []
        queue: Iterator[int] | None = None
        spare = seed
        while True:
            k = min(room, left[row])
            taken.append((row, start[row], k))
            start[row] += k
            left[row] -= k
            room -= k
            if not left[row]:
                used[row] = True
            if not room:
                break
            if queue is None:
                queue = index.best(seed, used)
            row = next((r for r in queue if not used[r]), -1)
            if row < 0:  # no neighbour is left: the next unused piece
                while spare < n and used[spare]:
                    spare += 1
                if spare == n:
                    break
                row = spare
        for row, s, k, q, o in cut(taken, window - room, window):
            yield row, s, k, sequence + q, o
        sequence += 1 if not room else (window - room).bit_count()


def cut(taken: list[tuple[int, int, int]], total: int, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """One full sequence, or sequences of falling powers of two."""
    bounds = [window] if total == window else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    q = offset = 0
    for row, s, k in taken:
        while k:
            part = min(k, bounds[q] - offset)
            yield row, s, part, q, offset
            s, k, offset = s + part, k - part, offset + part
            if offset == bounds[q]:
                q, offset = q + 1, 0


def _ids_type(size: int) -> np.dtype:
    """How ids are stored between the passes."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _tokeniser(spec: bytes, end_id: int, names: list[str]):
    """(id, ids, nothing) for each row, and at a task's end one row of the ids that occur and of the documents that hold each; the greatest id stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, key_type = loaded(spec), None
        kind, df = _ids_type(max(bpe.size, end_id + 1)), np.zeros(max(bpe.size, end_id + 1) + 1, np.int64)
        for b in batches:
            key_type = b.column(0).type
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                rows = [np.append(bpe(t.as_py() or ""), np.uint32(end_id)) for t in part.column(1)]
                for r in rows:
                    df[np.unique(r)] += 1
                df[-1] += len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.astype(kind).tobytes() for r in rows], pa.binary()), *[pa.nulls(len(rows), pa.list_(pa.int32()))] * 2], names=names)
        if key_type is not None:
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.nulls(1, pa.binary()), *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (seen, df[seen])]], names=names)

    return run


def races(df: np.ndarray) -> np.ndarray:
    """Two rows of arrival times of each id, exponential with its inverse document frequency as rate; the first to arrive names a document."""
    n = max(1, int(df[-1]))
    rate = np.log1p((n - df[:-1] + 0.5) / (df[:-1] + 0.5))
    draw = mix64(np.arange(2 * len(rate), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return -np.log((draw.reshape(2, -1).astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / rate


def _sketcher(times: np.ndarray, kind: np.dtype, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for b in batches:
            if not b.num_rows:
                continue
            ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column(1)]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat, at = np.concatenate(ids), np.cumsum(sizes) - sizes
            # a winner's arrival time names it; times of long documents are short, so ranges go by a hash of them
            first = [pa.array(mix64(np.minimum.reduceat(t[flat], at).view(np.uint64)).view(np.int64)) for t in times]
            salts = mix64(np.arange(salt, salt + len(ids), dtype=np.uint64)).view(np.int64)
            salt += len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *first, pa.array(salts)], names=names)

    return run


def _packer(kind: np.dtype, vocab: int, window: int, shard_tokens: int, with_ids: bool, names: list[str], id_type: pa.DataType):
    def flush(base: int, keys: list, texts: list[np.ndarray]) -> tuple[pa.RecordBatch, int]:
        out: list[tuple[int, int, int, int, int]] = []
        rows, shift = [], []
        sequence = 0
        for r, ids in enumerate(texts):
            full = len(ids) // window
            for k in range(full):
                out.append((r, k * window, window, sequence + k, 0))
            sequence += full
            if len(ids) % window:
                rows.append(r)
                shift.append(full * window)
        most = sequence
        for p, s, k, q, o in pack_shard([len(texts[r]) % window for r in rows], [texts[r] for r in rows], window, vocab):
            out.append((rows[p], shift[p] + s, k, sequence + q, o))
            most = max(most, sequence + q + 1)
        col = list(zip(*out, strict=True))
        cuts = [texts[r][s : s + k] for r, s, k, _, _ in out]
        data = [
            pa.array([keys[r] for r in col[0]], id_type),
            pa.array(col[1], pa.int64()),
            pa.array(col[2], pa.int64()),
            pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], pa.int64()),
            pa.array([len(texts[r]) for r in col[0]], pa.int64()),
            pa.array([base + q for q in col[3]], pa.int64()),
            pa.array(col[4], pa.int64()),
        ]
        if with_ids:
            flat = np.concatenate(cuts).astype(np.int32)
            data.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int32), flat))
        return pa.RecordBatch.from_arrays(data, names=names), base + most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        texts: list[np.ndarray] = []
        held = 0
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts.append(np.frombuffer(ids.as_py(), kind))
                keys.append(key)
                held += len(texts[-1])
                if held >= shard_tokens:
                    batch, base = flush(base, keys, texts)
                    yield batch
                    keys, texts, held = [], [], 0
        if texts:
            yield flush(base, keys, texts)[0]

    return run


def routed(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, ids in bytes) in ranges of their sketches, and the size of the vocabulary."""
    with open(tokenizer, "rb") as f:
        spec = zlib.compress(f.read())
    vocab = max(size_of(json.loads(zlib.decompress(spec))), end_id + 1)
    key = T.StructField("key", docs.schema[id_col].dataType)
    ids = T.StructField("ids", T.BinaryType())
    told = T.StructType([key, ids, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("t", "n"))])
    tokens = materialise(docs.select(id_col, text_col).mapInArrow(_tokeniser(spec, end_id, told.names), told), "pack-ids")
    df = np.zeros(vocab + 1, np.int64)
    for r in tokens.where("t is not null").select(F.inline(F.arrays_zip("t", "n"))).groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r.t] = r.n
    kind = _ids_type(vocab)
    drawn = T.StructType([key, ids, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("salt", T.LongType())])
    rows = tokens.where("ids is not null").select("key", "ids").mapInArrow(_sketcher(races(df), kind, drawn.names), drawn)
    placed = materialise(rows, "pack-sketches")
    discard(tokens)
    order = ["k1", "k2", "salt"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids"), vocab


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_tokens: int = 1 << 20, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``sequence_id`` is unique over the table: the range and a counter.
    ``window`` must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kind = docs.schema[id_col].dataType
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in longs)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    from pyspark.sql.pandas.types import to_arrow_type

    rows, vocab = routed(docs, tokenizer, end_id, id_col, text_col)
    run = _packer(_ids_type(vocab), vocab, window, shard_tokens, with_ids, [f.name for f in fields], to_arrow_type(kind))
    return rows.mapInArrow(run, T.StructType(fields))

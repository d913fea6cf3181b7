"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts by array operations on their UTF-8 bytes. The
trees learn on the driver from at most ``MAX_TRAIN`` labelled rows (those whose
ids hash least), with quantile bins, second-order gains and shrinkage. They
are flattened into arrays, one entry per node, and scoring walks all rows of a
batch down each tree at once with numpy.

Fold: ids whose crc32 as text leaves 1 modulo 3 are held out; labels, language,
source and id are never inputs.

Defined cases: null text is empty, and an empty text has the statistics zero;
rows with a null label don't train; several labels of one id count as their
greatest; without training rows every score is 0.5, with one class its smoothed
share; of several rows of one id the greatest statistics train, in whatever
order they come; equal statistics score alike, and ties between splits go to the
earlier statistic and bin; texts of any length count whole; empty tables give
empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SPACE, chunks, lower_ascii, run_starts, span_hash, tokens

#: Bound on the labelled rows that reach the driver.
MAX_TRAIN = 20_000


def _class(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


NEWLINE = _class(10)
CLASSES = {
    "upper": _class(*range(65, 91)),
    "lower": _class(*range(97, 123)),
    "digit": _class(*range(48, 58)),
    "high": _class(*range(128, 256)),
    "space": SPACE,
    "newline": NEWLINE,
    "stop": _class(*b".?!"),
    "comma": _class(*b",;:"),
    "quote": _class(*b"\"'()"),
    "hash": _class(*b"#*"),
    "money": _class(*b"$%&"),
    "pipe": _class(*b"|<>{}[]\\^~"),
    "bang": _class(*b"!"),
    "slash": _class(*b"/@_=+-"),
}
FEATURES = (
    ["bytes", "words", "lines", "word_mean", "word_sd", "short_words", "long_words", "line_mean", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "capital_words", "symbol_ends", "plain_ends", "stop_ends"]
    + list(CLASSES)
)
_ALNUM = CLASSES["upper"] | CLASSES["lower"] | CLASSES["digit"] | CLASSES["high"]


def features_of(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    parts = [np.zeros((0, len(FEATURES)), np.float32)]
    for _, data, offsets in chunks(texts):
        for a in range(0, len(offsets) - 1, 32_768):  # rows fit in 16 bits
            cut = offsets[a : a + 32_769]
            parts.append(_features(data[cut[0] : cut[-1]], cut - cut[0]))
    return np.concatenate(parts)


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its most frequent one occurs."""
    key = np.sort(rows.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    at = run_starts(key)
    row = (key[at] >> np.uint64(48)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row, np.diff(np.append(at, len(key))))
    return np.bincount(row, minlength=n), top


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    starts, ends, rows = tokens(data, offsets)
    words = np.bincount(rows, minlength=n)
    one = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(rows, length, n) / one
    sd = np.sqrt(np.maximum(0, np.bincount(rows, length**2, n) / one - mean**2))
    h = span_hash(lower_ascii(data), starts, ends)
    distinct, top = _distinct(rows, h, n)
    same = rows[1:] == rows[:-1]
    pairs = h[:-1][same] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:][same]
    pair_rows = rows[1:][same]
    line_starts, line_ends, line_rows = tokens(data, offsets, NEWLINE)
    lines = np.bincount(line_rows, minlength=n)
    distinct_lines = _distinct(line_rows, span_hash(data, line_starts, line_ends), n)[0]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    plain = _ALNUM[last]
    stop = CLASSES["stop"][last] | CLASSES["comma"][last]
    share = lambda mask: np.bincount(rows, mask, n) / one
    capital = CLASSES["upper"][data[starts]] & CLASSES["upper"][last] if len(starts) else np.zeros(0, bool)
    out = [
        np.log1p(size), np.log1p(words), np.log1p(lines), mean, sd, share(length <= 3), share(length >= 12), size / np.maximum(lines, 1),
        distinct / one, _distinct(pair_rows, pairs, n)[0] / np.maximum(np.bincount(pair_rows, minlength=n), 1), distinct_lines / np.maximum(lines, 1), top / one,
        share(capital), share(~plain & ~stop), share(plain), share(stop),
    ]
    total = np.zeros(len(data) + 1, np.int64)
    for table in CLASSES.values():
        np.cumsum(table[data], out=total[1:])
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    return np.stack(out, axis=1).astype(np.float32)


# --- trees ------------------------------------------------------------------------------------


@dataclass
class Trees:
    """All trees in flat arrays: a node's feature (-1: leaf), threshold, left child (right: + 1) and value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        raw = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                step = self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at])
                at = np.where(inner, step, at)
            raw += self.value[at]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boost logistic loss; deterministic."""
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # value <= cut[b] exactly if bin <= b
        flat = binned + np.arange(x.shape[1]) * bins
        raw = np.full(len(y), prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            work = [(roots[-1], np.arange(len(y)), 0)]
            while work:
                node, rows, level = work.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, -1)
                if level < depth and len(rows) >= 2 * least:
                    cells = flat[rows].ravel()
                    shape = (x.shape[1], bins)
                    hist = lambda w: np.bincount(cells, np.repeat(w[rows], x.shape[1]), x.shape[1] * bins).reshape(shape).cumsum(axis=1)  # noqa: B023, E731
                    gl, hl = hist(g), hist(h)
                    nl = np.bincount(cells, minlength=x.shape[1] * bins).reshape(shape).cumsum(axis=1)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    k = int(gain.argmax())
                    best = max(best, (float(gain.flat[k]), *divmod(k, bins)))
                if best[1] < 0:
                    value[node] = float(-rate * gs / (hs + l2))
                    raw[rows] += value[node]
                    continue
                _, f, b = best
                feature[node], threshold[node], left[node] = f, float(cuts[f][b]), len(feature)
                side = binned[rows, f] > b
                for part in (rows[~side], rows[side]):
                    feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                    work.append((len(feature) - 1, part, level + 1))
    as_array = lambda v, t: np.array(v, t)
    return Trees(as_array(roots, np.int64), as_array(feature, np.int64), as_array(threshold, np.float32), as_array(left, np.int64), as_array(value, np.float64), prior, depth)


# --- in Spark ---------------------------------------------------------------------------------


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Trees:
    """Learn from at most ``max_train`` labelled rows outside the held-out fold."""
    chosen = (
        labels.where(~held_out(id_col)).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.max(F.col(label_col)).cast("double").alias("y"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    )
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most max_train rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(b.column(1)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sample.select(id_col, text_col, "y").mapInArrow(run, schema).groupBy("id", "y").agg(F.max("x").alias("x")).toArrow()
    order = np.argsort(rows.column("id").to_numpy(zero_copy_only=False), kind="stable")
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return train(x[order], rows.column("y").to_numpy()[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.predict(features_of(b.column(2))))], names=schema.names)

    out = docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

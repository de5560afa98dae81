"""Quality scores: random Fourier features of document statistics, ridge by partition-summed normal equations,
isotonic calibration.

A text becomes STATISTICS numbers (case, digits, symbols, repetition, lines, word lengths), standardised; random
Fourier features approximate a Gaussian kernel over them. Every partition sums its part of the normal equations, a
few tasks add these up, and the driver solves for the ridge weights. Scores on the learning rows are counted in
BINS bins, again summed by partition, and pool-adjacent-violators over the bins calibrates them to probabilities.

Of more than LABELLED labelled rows a part is learnt from, chosen by a hash of the id.

Defined results: null and empty texts have the statistics of the empty text and are scored like any other; very long
texts are read whole, in memory that grows with the longest; ids without a label are scored but not learnt from;
repeated rows are scored alike and repeated labels count as often as they occur; without a label to learn from every
score is 0.5, and good() keeps every row. An empty table gives an empty result; other columns are ignored, and lang,
source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import fold, semi, stored, tuned
from .sums import partition_sum

STATISTICS, FEATURES, BINS, RIDGE, SEED = 24, 256, 2048, 1e-3, 7
#: Labelled rows that teach, at most in expectation, chosen by a hash of the id.
LABELLED = 500_000
_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 upper, 2 lower, 3 digit, 4 plain marks, 5 symbols, 6 blank, 7 line end, 8 not ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 8
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 6, 7
_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def _runs_distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: the number of distinct hashes, and the count of the commonest."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, doc[first], np.diff(np.append(first, len(h))))
    return np.bincount(doc[first], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """STATISTICS numbers for each text."""
    out = [np.zeros((0, STATISTICS))]
    for i, j, data, offsets in K.blocks(texts):
        n = j - i
        size = np.diff(offsets)
        owner = np.repeat(np.arange(n), size)
        kinds = np.bincount(owner * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
        seen = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256)
        part = seen / np.maximum(size, 1)[:, None]
        entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(1)
        starts, ends, doc = K.word_bounds(data, offsets)
        h = K.word_hashes(data, starts, ends)
        words = np.bincount(doc, minlength=n)
        per = np.maximum(words, 1)
        long = ends - starts
        distinct, most = _runs_distinct(h, doc, n)
        near = doc[1:] == doc[:-1]
        pairs, most_pair = _runs_distinct(K.mix(h[:-1] * np.uint64(3) + h[1:])[near], doc[1:][near], n)
        by = lambda x: np.bincount(doc, weights=x, minlength=n) / per
        line_start, line_end, line_doc = K.word_bounds(data, offsets, _LINE_END)
        lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
        line_hash = K.word_hashes(data, line_start)
        distinct_lines, _ = _runs_distinct(line_hash, line_doc, n)
        top = np.zeros(n)
        np.maximum.at(top, doc, long)
        of = kinds / np.maximum(size, 1)[:, None]
        out.append(np.stack([
            np.log1p(words), by(long), np.sqrt(by(np.square(long))), np.log1p(top), *of[:, 1:].T, distinct / per, pairs / np.maximum(words - 1, 1), most / per, most_pair / per,
            by(np.append(False, (h[1:] == h[:-1]) & near)) if len(h) else np.zeros(n), entropy, np.log1p(lines), distinct_lines / lines, np.log1p(words / lines), by(_CLASS[data[starts]] == 1), by(_CLASS[data[ends - 1]] >= 5), by(long <= 3),
        ], 1))
    return np.concatenate(out)


def statistics_table(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), STATISTICS).astype(np.float64)


def pool_adjacent_violators(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The ascending sequence nearest to mean under the weights."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.concatenate([np.full(int(k), m) for _, m, k in blocks]) if blocks else np.zeros(0)


class Model:
    """Standardisation, random features, ridge weights and the calibration's steps."""

    def __init__(self, center: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.center, self.scale = center, scale
        self.direction = rng.standard_normal((STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weight = np.zeros(FEATURES + 1)
        self.at, self.value, self.unlearnt = np.zeros(1), np.full(1, 0.5), True

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.center) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ self.direction + self.phase), np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.value)


def fit(labelled: DataFrame) -> Model:
    """The model of rows (stats, label)."""
    s = STATISTICS

    def moments(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x = _matrix(batch.column(0))
        total += np.concatenate([[len(x)], x.sum(0), np.square(x).sum(0)])

    total = partition_sum(labelled, 1 + 2 * s, moments)
    n = max(total[0], 1)
    center = total[1 : s + 1] / n
    model = Model(center, np.sqrt(np.maximum(total[s + 1 :] / n - center**2, 1e-8)))
    if not total[0]:
        return model
    f = FEATURES + 1

    def normal(total: np.ndarray, batch: pa.RecordBatch) -> None:
        z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        total[: f * f] += (z.T @ z).ravel()
        total[f * f :] += z.T @ y

    total = partition_sum(labelled, f * f + f, normal)
    model.weight = np.linalg.solve(total[: f * f].reshape(f, f) + RIDGE * n * np.eye(f) / FEATURES, total[f * f :])

    def histogram(total: np.ndarray, batch: pa.RecordBatch) -> None:
        raw, y = model.raw(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        total += np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    total = partition_sum(labelled, 2 * BINS, histogram)
    used = np.flatnonzero(total[:BINS])
    model.unlearnt = False
    model.at = (used + 0.5) / BINS * 2 - 0.5
    model.value = np.clip(pool_adjacent_violators(total[used], total[BINS + used] / total[used]), 0, 1)
    return model


def taught(labels: DataFrame, train: Column | None) -> DataFrame:
    """The labels (doc_id, quality) that teach: those under train, LABELLED at most in expectation, so that neither texts
    nor statistics are shuffled to meet them."""
    known = labels.filter(F.col("quality").isNotNull() & (fold("doc_id", 4) != 2 if train is None else train)).select("doc_id", "quality")
    share = min(1.0, LABELLED / max(1, known.count()))
    return known if share == 1 else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def _model(stats: DataFrame, labels: DataFrame, train: Column | None) -> Model:
    known = taught(labels, train).select("doc_id", F.col("quality").cast("double").alias("label"))
    return fit(stored(stats.join(F.broadcast(known), "doc_id").select("stats", "label"), "labelled"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: Column | None = None) -> DataFrame:
    """doc_id, score and predicted of every row of docs; labels (doc_id, quality) under train teach."""
    spark = tuned(docs.sparkSession)
    stats = stored(statistics_table(docs), "statistics")
    model = spark.sparkContext.broadcast(_model(stats, labels, train))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: Column | None = None) -> DataFrame:
    """The rows of docs, all columns, with a score of at least threshold; all rows when there is no label to learn from."""
    spark = tuned(docs.sparkSession)
    known = taught(labels, train)
    texts = semi(docs.select("doc_id", "text"), known.select("doc_id"), "doc_id")
    model = spark.sparkContext.broadcast(_model(statistics_table(texts), known, F.lit(True)))
    at = docs.columns.index("text")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.value
            yield batch if m.unlearnt else batch.filter(pa.array(m.score(statistics(batch.column(at))) >= threshold, pa.bool_()))

    return docs.mapInArrow(sieve, docs.schema)

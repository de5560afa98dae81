"""Text scores from a log-bilinear model trained with noise-contrastive estimation, and from counted words.

Tokens are words (A-Z folded) and an end for each text. All training texts are counted. The model's symbols are the
commonest tokens and classes of all others by their last bytes: the log-bilinear part gives normalised probabilities
of the next symbol after the two before it, and within a class a token's share is its count plus one, with one more
for all unseen ones, so that probabilities of tokens add up to one. Both the short list and the classes grow with the
cube root of the vocabulary, from SHORT and CLASSES (see symbol_counts()).

Training is by noise-contrastive estimation in numpy. All tasks begin with the same random parameters; EPOCHS times,
every task goes through all training texts of its partition, and the tasks' parameters are averaged by their tokens,
in pieces, so that neither the driver nor a task sees texts or more than a piece of each task's parameters. The
normaliser of a context is the sum over symbols of a product of one factor for each of its two places: a matrix product
gives those of all contexts, while a table of them is small, else those of a batch.

Counts of the TOP commonest tokens are broadcast (the bound is on their number); rarer tokens of a text are joined
with the counts by hash.

Defined results: null and empty texts are one end; without any training row nothing is known and symbols are equally
likely; repeated rows are separate texts; a very long text is read whole, in memory that grows with the longest; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import dropped, fold, stored, tuned

SHORT, CLASSES, TOP = 768, 256, 1 << 18
#: Distinct words up to which SHORT and CLASSES hold, and the low bits of a key that have its class.
LEAST_WORDS, CLASS_BITS = 400_000, 16
WIDTH, NOISE, BATCH, EPOCHS, RATE = 32, 64, 4096, 3, 0.3
#: Pieces that parameters are averaged in, and normalisers that a worker keeps.
PIECES, KEPT = 256, 1 << 24
END = np.uint64(0x454E4400)
#: Tokens whose counts are put together before they are shuffled.
COUNT_TOKENS = 4_000_000
_LAST_TWO = K.mix(np.arange(65536, dtype=np.uint64)) & np.uint64(255)
_THIRD = (K.mix(np.arange(256, dtype=np.uint64)) & np.uint64((1 << CLASS_BITS - 8) - 1)) << np.uint64(8)


def symbol_counts(distinct: int) -> tuple[int, int]:
    """The short list and the classes (a power of two) for so many distinct words."""
    grown = max(1.0, distinct / LEAST_WORDS) ** (1 / 3)
    return round(SHORT * grown), min(CLASSES << round(math.log2(grown)), 1 << CLASS_BITS)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of some texts, ends included, and the text of each. A key is the word's hash with its class
    in the low bits."""
    starts, ends, doc = K.word_bounds(data, offsets)
    n = len(offsets) - 1
    last = K.LOWER[data[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, K.LOWER[data[ends - 2]], 0).astype(np.int64) if len(ends) else last
    third = K.LOWER[data[np.maximum(ends - 3, starts)]].astype(np.int64) if len(ends) else last
    key = (K.word_hashes(data, starts, ends) & ~np.uint64((1 << CLASS_BITS) - 1)) | _LAST_TWO[last * 256 + before] | _THIRD[third]
    out = np.full(len(key) + n, END, np.uint64)
    out[np.arange(len(key)) + doc] = key
    return out, np.repeat(np.arange(n), np.bincount(doc, minlength=n) + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(key, n) of all tokens of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(0)):
                held.append(tokens(data, offsets)[0])
                size += len(held[-1])
                if size > COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """top: ascending keys of the commonest tokens, with counts and symbols (classes are the last symbols), and how often
    each symbol occurs."""

    top: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    n_symbols: int
    class_log: np.ndarray
    total: int = 0
    distinct: int = 0
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    bias: np.ndarray = field(default=None)
    normaliser: np.ndarray = field(default=None)
    classes: int = CLASSES
    frequency: np.ndarray = field(default=None)

    def class_of(self, key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(self.classes - 1)).astype(np.int64)

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not among the commonest) and symbols."""
        symbol = self.n_symbols - self.classes + self.class_of(key)
        if not len(self.top):
            return np.full(len(key), -1), symbol
        at = np.searchsorted(self.top, key)
        at[at == len(self.top)] = 0
        hit = self.top[at] == key
        listed = hit & (self.symbol[at] >= 0)
        return np.where(hit, self.count[at], -1), np.where(listed, self.symbol[at], symbol)

    def contexts(self, symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols one and two places before; n_symbols stands before the first."""
        one, two = np.full(len(symbol), self.n_symbols), np.full(len(symbol), self.n_symbols)
        near = doc[1:] == doc[:-1]
        one[1:][near] = symbol[:-1][near]
        far = doc[2:] == doc[:-2]
        two[2:][far] = symbol[:-2][far]
        return one, two

    def log_normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all symbols, for each context."""
        size = self.n_symbols + 1
        if size * size > KEPT:
            at, place = np.unique(one * size + two, return_inverse=True)
            return self._normalisers(at // size, at % size)[place]
        if self.normaliser is None:
            (a, most_a), (b, most_b) = self._factors(self.left, self.bias), self._factors(self.right, 0)
            self.normaliser = np.log(a @ b.T) + most_a[:, None] + most_b
        return self.normaliser[one, two]

    def _factors(self, side: np.ndarray, bias) -> tuple[np.ndarray, np.ndarray]:
        """What each context's place brings to every symbol, as a share of its largest, and the logarithm of that."""
        logits = side @ self.out.T + bias
        most = logits.max(1)
        return np.exp(logits - most[:, None]), most

    def _normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Those of the contexts of a batch."""
        made, step = np.zeros(len(one), np.float32), max(64, (1 << 22) // self.n_symbols)
        for i in range(0, len(one), step):
            (x, a), (y, b) = np.unique(one[i : i + step], return_inverse=True), np.unique(two[i : i + step], return_inverse=True)
            (f, most_f), (g, most_g) = self._factors(self.left[x], self.bias), self._factors(self.right[y], 0)
            made[i : i + step] = np.log(np.einsum("ij,ij->i", f[a], g[b])) + most_f[a] + most_g[b]
        return made

    def log10_symbols(self, symbol: np.ndarray, doc: np.ndarray) -> np.ndarray:
        one, two = self.contexts(symbol, doc)
        logit = np.einsum("ij,ij->i", self.left[one] + self.right[two], self.out[symbol]) + self.bias[symbol]
        return (logit.astype(np.float64) - self.log_normalisers(one, two)) / np.log(10)


class Trainer:
    """Noise-contrastive estimation: tell each symbol that follows a context from NOISE symbols drawn by frequency."""

    def __init__(self, model: Model, seed: int = 11):
        n, rng = model.n_symbols, np.random.Generator(np.random.PCG64(seed))
        self.noise = (model.frequency + 1.0) / (model.frequency.sum() + n)
        self.x = [rng.normal(0, 0.05, (n + k, WIDTH)).astype(np.float32) for k in (1, 1, 0)] + [np.log(self.noise).astype(np.float32)]
        self.square = [np.full(x.shape, 1e-2, np.float32) for x in self.x]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.x + self.square])

    def fill(self, flat: np.ndarray) -> None:
        parts = np.split(flat, np.cumsum([x.size for x in self.x + self.square])[:-1])
        shaped = [part.reshape(x.shape).copy() for part, x in zip(parts, self.x + self.square)]
        self.x, self.square = shaped[: len(self.x)], shaped[len(self.x) :]

    def _step(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        x, square = self.x[which], self.square[which]
        cells = rows if grad.ndim == 1 else (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        total = np.bincount(cells, weights=grad.ravel(), minlength=x.size).astype(np.float32).reshape(x.shape)
        square += total * total
        total /= np.sqrt(square)
        total *= np.float32(RATE)
        x += total

    def go_through(self, model: Model, symbol: np.ndarray, doc: np.ndarray, rng: np.random.Generator) -> None:
        """Every symbol of some texts once, in random order."""
        offset, cumulative = np.log(NOISE * self.noise).astype(np.float32), np.cumsum(self.noise)
        one, two = model.contexts(symbol, doc)
        order = rng.permutation(len(symbol))

        def doubt(logit: np.ndarray) -> np.ndarray:
            """1 / (1 + exp(logit)) in place."""
            np.minimum(logit, 60, out=logit)
            np.exp(logit, out=logit)
            logit += 1
            return np.reciprocal(logit, out=logit)

        for i in range(0, len(order), BATCH):
            left, right, out, bias = self.x
            at = order[i : i + BATCH]
            a, b, w = one[at], two[at], symbol[at]
            fake = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), model.n_symbols - 1)
            q, true, false, size = left[a] + right[b], out[w], out[fake], np.float32(len(at))
            real = doubt(np.einsum("ij,ij->i", q, true) + bias[w] - offset[w]) / size
            lie = q @ -false.T
            lie -= bias[fake] - offset[fake]
            lie = doubt(lie)
            lie /= size
            grad = np.concatenate([real[:, None] * q, -(lie.T @ q)])
            true *= real[:, None]
            true -= lie @ false
            rows = np.concatenate([w, fake])
            self._step(2, rows, grad)
            self._step(3, rows, np.concatenate([real, -lie.sum(0)]))
            self._step(0, a, true)
            self._step(1, b, true)

    def finish(self, model: Model) -> None:
        model.left, model.right, model.out, model.bias = self.x


def train(model: Model, sequences: list[np.ndarray], seed: int = 11) -> Trainer:
    """A pass over some sequences of symbols, after which the model can be used."""
    symbol = np.concatenate([*sequences, np.zeros(0, np.int64)]).astype(np.int64)
    if model.frequency is None:
        model.frequency = np.bincount(symbol, minlength=model.n_symbols).astype(float)
    trainer = Trainer(model, seed)
    trainer.go_through(model, symbol, np.repeat(np.arange(len(sequences)), [len(s) for s in sequences]), np.random.Generator(np.random.PCG64(seed + 1)))
    trainer.finish(model)
    return trainer


def averaged(texts: DataFrame, kind: str, model: Model, trainer: Trainer, seed: int) -> None:
    """One pass of every task over all texts (symbols of type kind) of its partition; the trainer takes the mean of their parameters,
    weighted by tokens. It is formed in PIECES groups, so no task holds more than a piece of each partition's."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((model, trainer))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, given = shared.value
        own, n = Trainer(m), 0
        own.fill(given.flat())
        rng = np.random.Generator(np.random.PCG64([seed, TaskContext.get().partitionId()]))
        for batch in batches:
            per = np.asarray(pc.binary_length(batch.column(0))).astype(np.int64) // np.dtype(kind).itemsize
            symbol = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).astype(np.int64)
            own.go_through(m, symbol, np.repeat(np.arange(len(per)), per), rng)
            n += len(symbol)
        if n:
            parts = [x.tobytes() for x in np.array_split(own.flat(), PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([n] * PIECES, pa.int64()), pa.array(parts, pa.binary())], ["piece", "n", "x"])

    def mean(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        total, n = 0.0, 0
        for x, k in zip(frame["x"], frame["n"].to_pylist()):
            total, n = total + np.frombuffer(x.as_buffer(), np.float32) * float(k), n + k
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "x": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    schema = "piece int, n long, x binary"
    rows = sorted(texts.select("symbols").mapInArrow(local, schema).groupBy("piece").applyInArrow(mean, schema).collect(), key=lambda r: r["piece"])
    if rows:
        trainer.fill(np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows]))
        trainer.finish(model)
    shared.unpersist()


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of the training texts docs and their counts."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    sizes = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(TOP).collect()
    least, kept = None, 0
    for r in sizes:
        if kept + r["k"] > TOP:
            break
        least, kept = r["n"], kept + r["k"]
    rows = counts.filter(F.col("n") >= least).toPandas() if least else counts.limit(0).toPandas()  # TOP rows at most
    rows = rows.sort_values(["n", "key"], ascending=False).reset_index(drop=True)
    short, classes = symbol_counts(distinct or 0)
    listed = set(rows["key"][:short])
    listed |= {int(END)} & set(rows["key"])
    symbol = np.full(len(rows), -1)
    symbol[rows["key"].isin(listed)] = np.arange(len(listed))
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    model = Model(key[order], rows["n"].to_numpy(np.int64)[order], symbol[order], len(listed) + classes, np.zeros(classes), total or 0, distinct, classes=classes)
    size, often = np.ones(classes), np.zeros(len(listed) + classes)
    for r in counts.groupBy(F.col("key").bitwiseAND(classes - 1).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        size[r["c"]] += r["n"] + r["k"]
        often[len(listed) + r["c"]] += r["n"]
    for k, n, at in zip(rows["key"], rows["n"], symbol):
        if at >= 0:
            size[k & (classes - 1)] -= n + 1
            often[len(listed) + (k & (classes - 1))] -= n
            often[at] = n
    model.class_log, model.frequency = np.log10(size), often

    kind = "<u2" if model.n_symbols < 1 << 16 else "<u4"

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.blocks(batch.column(0)):
                key, doc = tokens(data, offsets)
                symbols = model.look_up(key)[1].astype(kind)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))]) * symbols.itemsize
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(symbols)])
                yield pa.RecordBatch.from_arrays([parts.cast(pa.binary())], ["symbols"])

    texts = stored(docs.select("text").mapInArrow(sequences, "symbols binary"), "symbols")
    trainer = Trainer(model)
    trainer.finish(model)
    for k in range(EPOCHS if total else 0):
        averaged(texts, kind, model, trainer, k)
    dropped(texts)
    return model


def score_texts(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; training: the
    condition of the rows that are learnt from (all but a fold of ids)."""
    spark = tuned(docs.sparkSession)
    condition = fold("doc_id", 7) != 2 if training is None else training
    docs = docs.select("doc_id", "text", (~condition).alias("held_out"))
    taught = docs.filter(~F.col("held_out"))
    counts = stored(count_tokens(taught), "counts")
    fitted = fit(taught, counts)
    least = int(fitted.count.min()) if len(fitted.count) else 0
    model = spark.sparkContext.broadcast(fitted)
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, fixed double, rare array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i, j, data, offsets in K.blocks(batch.column(1)):
                key, doc = tokens(data, offsets)
                count, symbol = m.look_up(key)
                per = np.bincount(doc, minlength=j - i)
                top = count >= 0
                logs = np.where(top, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                open_ = symbol >= m.n_symbols - m.classes
                fixed = m.log10_symbols(symbol, doc) + np.where(open_, logs - m.class_log[m.class_of(key)], 0.0)
                by = lambda x: np.bincount(doc, weights=x, minlength=j - i)
                rare = np.concatenate([[0], np.cumsum(np.bincount(doc[~top], minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(per.astype(np.int64)), pa.array(by(top).astype(np.int64)), pa.array(by(logs)), pa.array(by(fixed)),
                    pa.ListArray.from_arrays(pa.array(rare), pa.array(K.signed(key[~top]))),
                ], ["doc_id", "held_out", "n_tokens", "known", "logs", "fixed", "rare"])

    rows = stored(docs.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    found = rows.select("row", F.explode("rare").alias("key")).join(counts.filter(F.col("n") < least) if least else counts, "key")
    found = found.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("extra"))
    more, extra = F.coalesce("more", F.lit(0)), F.coalesce("extra", F.lit(0.0))
    size = float(np.log10(fitted.total + fitted.distinct + 1.0))
    return rows.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(int(fitted.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.lit(size)).alias("base_score"), (F.col("fixed") + extra).alias("score"),
    )

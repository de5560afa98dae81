"""Language identification with word-first backoff.

A word seen in training counts its log frequency in each language. An unseen word falls back to its character
n-grams: the longest order (5, 4, ... 1 letters, marked at a word's begin and end) of which training knows any
decides, by the mean log frequency of the known ones. A text's languages compare by their mean over words.

Learning takes the training rows' whole texts, TRAIN_DOCS of them in expectation (chosen by a hash of the id), but of
each language LANGUAGE_DOCS at least or all that it has. It keeps the WORDS and GRAMS commonest entries of all and the
LANGUAGE_WORDS and LANGUAGE_GRAMS commonest of each language. Every language takes part; the model is sparse, so it
grows with the number of languages, but not with the rows.

Defined results: null and empty texts and texts without a letter are `und` with score 0; so is everything when
no training row has a language. Repeated rows are scored alike; an empty table gives an empty result; columns
other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import letters
from .common import fold, stored, tuned

TRAIN_DOCS, WORDS, GRAMS, ORDER = 8_000, 60_000, 120_000, 5
#: What each language has at least.
LANGUAGE_DOCS, LANGUAGE_WORDS, LANGUAGE_GRAMS = 1_000, 5_000, 10_000
#: A text's evidence counts as that of so many words at most when scores are made of it.
EVIDENCE = 12
UNKNOWN = "und"


def _count(languages: list[str]):
    at = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([at[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j, words in letters.blocks(batch.column(0)):
                every = np.arange(len(words.start))
                for kind in range(ORDER + 1):
                    h, owner = words.grams(every, kind) if kind else (words.hashes(), every)
                    if not len(h):
                        continue
                    lang_of = lang[i:j][words.doc[owner]]
                    order = np.lexsort((lang_of, h))
                    h, lang_of = h[order], lang_of[order]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lang_of[1:] != lang_of[:-1])))
                    n = np.diff(np.append(first, len(h)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), kind, np.int32)), pa.array(h[first].view(np.int64)), pa.array(lang_of[first].astype(np.int32)), pa.array(n.astype(np.int64))],
                        ["kind", "hash", "lang", "n"],
                    )

    return count


class Table:
    """Ascending hashes; for each the languages it was seen in, with how much its log frequency there exceeds that of an
    unseen entry; and the log frequencies of unseen entries by kind and language."""

    def __init__(self, rows, n_languages: int):
        h, kind, lang, n = (rows[c].to_numpy() for c in ("hash", "kind", "lang", "n"))
        h = h.astype(np.int64).view(np.uint64)
        order = np.lexsort((lang, h))
        h, kind, self.lang = h[order], kind[order], lang[order].astype(np.int64)
        n = n[order].astype(np.float64)
        self.keys, first = np.unique(h, return_index=True)
        self.first = np.append(first, len(h))
        self.more = np.log((n + 0.1) / 0.1).astype(np.float32)
        self.base = np.zeros((ORDER + 1, n_languages))
        for k in np.unique(kind):
            total = np.bincount(self.lang[kind == k], weights=n[kind == k], minlength=n_languages)
            base = np.log(0.1 / (total + 0.1 * np.count_nonzero(kind[first] == k)))
            base[total == 0] = base.min(initial=0) - 1  # nothing seen of a language is no evidence for it
            self.base[k] = base

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1)

    def add(self, sums: np.ndarray, kind: int, row: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        """Adds the weighted log frequencies of rows to the sums (texts by languages)."""
        n_docs, n_languages = sums.shape
        sums += np.bincount(doc, weights=weight, minlength=n_docs)[:, None] * self.base[kind]
        per = self.first[row + 1] - self.first[row]
        at = np.arange(per.sum()) + np.repeat(self.first[row] - np.cumsum(per) + per, per)
        cell = np.repeat(doc * n_languages, per) + self.lang[at]
        sums += np.bincount(cell, weights=self.more[at] * np.repeat(weight, per), minlength=sums.size).reshape(sums.shape)


class Model:
    """languages; tables of words and of grams."""

    def __init__(self, languages: list[str], words: Table, grams: Table):
        self.languages, self.words, self.grams = languages, words, grams

    def sums(self, words: letters.Words, n_docs: int) -> np.ndarray:
        """Texts by languages: the sums of log frequencies over words."""
        sums = np.zeros((n_docs, len(self.languages)))
        row = self.words.find(words.hashes())
        known = row >= 0
        self.words.add(sums, 0, row[known], words.doc[known], np.ones(int(known.sum())))
        rest = np.flatnonzero(~known)
        for n in range(ORDER, 0, -1):
            if not len(rest):
                break
            h, owner = words.grams(rest, n)
            row = self.grams.find(h)
            owner, row = owner[row >= 0], row[row >= 0]
            per = np.bincount(owner, minlength=len(rest))
            if len(owner):
                self.grams.add(sums, n, row, words.doc[rest[owner]], 1 / per[owner])
            rest = rest[per == 0]
        return sums

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for i, j, words in letters.blocks(texts):
            per = np.bincount(words.doc, minlength=j - i)
            mean = self.sums(words, j - i) / np.maximum(per, 1)[:, None]
            mean = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(per, EVIDENCE)[:, None])
            best = mean.argmax(1)
            names += [self.languages[b] if n else UNKNOWN for b, n in zip(best, per)]
            scores.append(np.where(per > 0, mean.max(1) / mean.sum(1), 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, train: Column) -> Model | None:
    """The model of docs' rows under the condition train that have a language."""
    rows = docs.filter(train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    kinds = rows.groupBy("lang").count().collect()
    if not kinds:
        return None
    share = TRAIN_DOCS / sum(r["count"] for r in kinds)
    languages = sorted(r["lang"] for r in kinds)
    below = [(r["lang"], int(min(1.0, max(share, LANGUAGE_DOCS / r["count"])) * (1 << 20)) + 1) for r in kinds]
    below = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below int"))  # a row a language
    some = rows.join(below, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("below"))
    counts = stored(some.select("text", "lang").mapInArrow(_count(languages), "kind int, hash long, lang int, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n")), "language")
    tables = []
    for kind, size, each in ((F.col("kind") == 0, WORDS, LANGUAGE_WORDS), (F.col("kind") > 0, GRAMS, LANGUAGE_GRAMS)):
        total = counts.filter(kind).groupBy("kind", "hash").agg(F.sum("n").alias("all")).filter("all > 1")
        top = total.orderBy(F.desc("all"), "kind", "hash").limit(size).drop("all")
        of_language = Window.partitionBy("lang").orderBy(F.desc("n"), "kind", "hash")
        own = counts.filter(kind & (F.col("n") > 1)).withColumn("place", F.row_number().over(of_language)).filter(F.col("place") <= each)
        chosen = top.union(own.select("kind", "hash")).distinct()
        tables.append(Table(counts.join(chosen, ["kind", "hash"]).toPandas(), len(languages)))  # size + each a language, at most
    return Model(languages, *tables)


def _fitted(docs: DataFrame, train: Column | None):
    spark = tuned(docs.sparkSession)
    return spark.sparkContext.broadcast(fit(docs, fold("doc_id", 4) != 2 if train is None else train))


def _predict(model: Model | None, text: pa.Array) -> tuple[list[str], np.ndarray]:
    return model.predict(text) if model else ([UNKNOWN] * len(text), np.zeros(len(text)))


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row. Learns from the rows of docs under train (all but a fold of ids)."""
    model = _fitted(docs, train)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def in_known_language(docs: DataFrame, least: float = 0.5, train: Column | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of at least least."""
    model = _fitted(docs, train)
    at = docs.columns.index("text")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(model.value, batch.column(at))
            yield batch.filter(pa.array((np.array(names, object) != UNKNOWN) & (scores >= least), pa.bool_()))

    return docs.mapInArrow(sieve, docs.schema)

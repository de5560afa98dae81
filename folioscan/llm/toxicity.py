"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other. Four transducers are composed
into one: the first marks insults and threats as aimed when the clause holds a target, before or after; the second
turns those shortly behind a negation into negated ones; the third those behind reported speech into reported
ones; the last emits the events that are left. The least path through the composition reads a clause; a text's
events are counted, and a logistic model of the counts gives the score.

Learning: words and word beginnings (3 to 6 letters) that occur in toxic rather than clean labelled texts become
insults: those in a share STRONG of the toxic texts, and more, greedily, so that every toxic text is covered by COVER
of them where it can be. Of texts that share their least long word by hash (near copies mostly do) one is learnt
from, so that the words of an often copied text prove nothing. Then the events' weights are fitted around their prior.
Both use TRAIN_DOCS toxic and twice as many clean labelled ids at most in expectation, chosen by a hash of the id
before texts are joined. Threats, targets, negations and verbs of report are fixed lists: they are closed classes,
mostly of function words, which clean texts hold as often, so labels of texts cannot teach them; what the lists
lack of threats is learnt as insults are.

Defined results: null and empty texts and texts without a matched clause have the base score; without labels the
fixed words and prior weights stand; repeated rows are scored alike; a very long clause costs time in proportion to
its words and no more memory than a short one; an empty table gives an empty result; other columns are ignored, and
labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import letters
from .common import fold, stored, tuned
from .wfst import EPSILON, Wfst, compose, renumbered

TRAIN_DOCS, CANDIDATES, COVER, STRONG, LEAST_DOCS = 2_000, 4_000, 3, 0.02, 4
PREFIXES = (3, 4, 5, 6)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oITPNR"
EVENTS = ["insult", "aimed insult", "threat", "aimed threat", "negated", "reported"]
#: Base and weights of the events before anything is learnt.
PRIOR = np.array([-4.0, 6.0, 7.0, 3.0, 7.0, 1.0, 1.5])
FIXED = {
    INSULT: "idiot stupid moron scum loser pathetic worthless",
    THREAT: "kill hurt destroy strangle murder beat burn töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours he him she her they them people du dich dir ihr euch sie er tu toi vous ils elle lui él ella ellos usted ustedes ti",
    NEGATION: "not no never neither nor without nicht kein keine nie pas jamais ne ni nunca jamás sin",
    REPORT: "said says wrote quoted called according reported sagte schrieb zitierte dit écrit selon dijo escribió según",
}
SCOPE = 3
_RUN = re.compile(f"{OTHER}{{{SCOPE + 1},}}")
_MARKS = np.zeros(0x110000, bool)
_MARKS[[ord(c) for c in ".!?;:,\n()\"…"]] = True


def grammar() -> Wfst:
    """Classes of a clause's words -> events."""
    aim = Wfst("open", finals={"open": 0.0, "met": 0.0})
    for state in ("open", "met", "promised"):
        for c in (OTHER, NEGATION, REPORT):
            aim.add(state, c, c, 0.0, state)
        aim.add(state, TARGET, TARGET, 0.0, "met")
        for c, aimed, plain in ((INSULT, "a", "i"), (THREAT, "A", "t")):
            if state == "open":
                aim.add(state, c, plain, 1.0, "open")
            aim.add(state, c, aimed, 0.0, "promised" if state != "met" else "met")
    deny = Wfst(0, finals={k: 0.0 for k in range(SCOPE + 1)})
    tell = Wfst(0, finals={0: 0.0, 1: 0.0})
    for k in range(SCOPE + 1):
        for c in (OTHER, TARGET, REPORT):
            deny.add(k, c, c, 0.0, max(0, k - 1))
        deny.add(k, NEGATION, NEGATION, 0.0, SCOPE)
        for c in "aitA":
            deny.add(k, c, "n" if k else c, 0.0, max(0, k - 1))
    for k in (0, 1):
        for c in (OTHER, TARGET, NEGATION, "n"):
            tell.add(k, c, c, 0.0, k)
        tell.add(k, REPORT, REPORT, 0.0, 1)
        for c in "aitA":
            tell.add(k, c, "r" if k else c, 0.0, k)
    emit = Wfst(0, finals={0: 0.0})
    for c in (OTHER, TARGET, NEGATION, REPORT):
        emit.add(0, c, EPSILON, 0.0, 0)
    for c, e in zip("iatAnr", range(len(EVENTS))):
        emit.add(0, c, e, 0.0, 0)
    return renumbered(compose(compose(compose(aim, deny), tell), emit))


_GRAMMAR = grammar()
_TABLE = _GRAMMAR.by_input()


#: Clauses up to so many classes are remembered, so many of them.
SHORT_CLAUSE, CLAUSES = 48, 100_000
_NO_EVENTS = (0,) * len(EVENTS)


def _least_path(classes: str) -> tuple[int, ...]:
    """Counts of EVENTS on the least path of a clause: one pass over it, with a weight and counts for each state."""
    front = {_GRAMMAR.start: (0.0, _NO_EVENTS)}
    for c in classes:
        new: dict = {}
        for state, (weight, events) in front.items():
            for out, w, then in _TABLE.get(state, {}).get(c, ()):
                if then not in new or weight + w < new[then][0]:
                    new[then] = (weight + w, events if out == EPSILON else (*events[:out], events[out] + 1, *events[out + 1 :]))
        front = new
    return min((w + _GRAMMAR.finals[s], e) for s, (w, e) in front.items() if s in _GRAMMAR.finals)[1]


_remembered = lru_cache(CLAUSES)(_least_path)


def read_clause(classes: str) -> tuple[int, ...]:
    return _remembered(classes) if len(classes) <= SHORT_CLAUSE else _least_path(classes)


def _features(words: letters.Words, which: np.ndarray) -> list[np.ndarray]:
    """Hashes of words and of their beginnings; 0 where a word is not longer than that."""
    out = [words.hashes()[which]]
    for n in PREFIXES:
        long = words.length[which] > n
        h = np.zeros(len(which), np.uint64)
        h[long] = words.spans(words.start[which][long], np.full(int(long.sum()), n), 64 + n)
        out.append(h)
    return out


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    keys, classes = [], []
    for c, text in FIXED.items():
        words = letters.Words(pa.array([text], pa.large_string()))
        keys.append(words.hashes())
        classes += [c] * len(words.start)
    keys, classes = np.concatenate(keys), np.array(classes)
    keys, first = np.unique(keys, return_index=True)
    return keys, classes[first]


class Model:
    """Ascending hashes of words and beginnings with their classes; base and weights of the events."""

    def __init__(self, insults: np.ndarray):
        keys, classes = _fixed()
        insults = np.setdiff1d(insults, keys)
        keys, classes = np.concatenate([keys, insults]), np.concatenate([classes, np.full(len(insults), INSULT)])
        order = np.argsort(keys)
        self.keys, self.classes, self.weights = keys[order], classes[order], PRIOR.copy()

    def classify(self, words: letters.Words) -> np.ndarray:
        out = np.full(len(words.start), OTHER)
        for h in reversed(_features(words, np.arange(len(words.start)))):
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h
            out[hit] = self.classes[at[hit]]
        return out

    def events(self, texts: pa.Array) -> np.ndarray:
        """Counts of EVENTS in each text."""
        found = [np.zeros((0, len(EVENTS)))]
        for i, j, words in letters.blocks(texts):
            count = np.zeros((j - i, len(EVENTS)))
            classes = self.classify(words)
            hot = np.flatnonzero((classes == INSULT) | (classes == THREAT))
            if len(hot):
                marks = np.concatenate([[0], np.cumsum(_MARKS[words.code])])
                clause = marks[words.start] + words.doc  # grows at every mark and every text
                first, last = np.searchsorted(clause, clause[hot]), np.searchsorted(clause, clause[hot], "right")
                for a, b in sorted(set(zip(first.tolist(), last.tolist()))):
                    # longer runs of others make no difference
                    count[words.doc[a]] += read_clause(_RUN.sub(OTHER * SCOPE, "".join(classes[a:b])))
            found.append(count)
        return np.concatenate(found)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + np.log2(1 + self.events(texts)) @ self.weights[1:])))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (hash, toxic, texts that hold it)"""
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        for i, j, words in letters.blocks(batch.column(0)):
            for h in _features(words, np.arange(len(words.start))):
                some = h != 0
                h, doc = h[some], words.doc[some]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
                h, label = h[once], toxic[i:j][doc[once]]
                for t in (0, 1):
                    key, n = np.unique(h[label == t], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), t, np.int32)), pa.array(n.astype(np.int64))], ["hash", "toxic", "n"])


def choose_insults(cover: list[np.ndarray], n: int) -> np.ndarray:
    """Greedy choice of features (of n) by the texts they cover, each text wanting COVER of its features; cover: the
    features of each toxic text."""
    holds = np.zeros((len(cover), n), bool)
    for i, c in enumerate(cover):
        holds[i, c] = True
    least = max(LEAST_DOCS, len(cover) // 400)
    strong = np.flatnonzero(holds.sum(0) >= max(2 * LEAST_DOCS, STRONG * len(cover)))
    need, chosen = COVER - holds[:, strong].sum(1), strong.tolist()
    holds[:, strong] = False
    while n and (need > 0).any():
        gain = holds[need > 0].sum(0)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        need[holds[:, best]] -= 1
        holds[:, best] = False
    return np.array(chosen, np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of the penalised likelihood around a prior, by Newton steps that are halved until they gain."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + np.square(w - prior).sum() / 2)

    w = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - (w - prior))
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sampled(labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Of labels (doc_id, toxic) those that are learnt from, and the share of each label that they are."""
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = {t: min(1.0, TRAIN_DOCS * (2 - t) / n) for t, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    below = {t: int(s * (1 << 40)) for t, s in share.items()}
    return labels.filter(place < F.when(F.col("toxic") == 1, F.lit(below.get(1, 0))).otherwise(F.lit(below.get(0, 0)))), share


def fit(taught: DataFrame, share: dict[int, float]) -> Model:
    """The model of rows (doc_id, text, toxic), drawn by the shares of their labels."""
    if not share.get(1) or not share.get(0):
        return Model(np.zeros(0, np.uint64))
    some = stored(taught, "toxic-sample")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    family = F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    some = stored(some.withColumn("family", family).dropDuplicates(["family", "toxic"]), "toxic-families").select("text", "toxic")
    drawn = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    toxic, clean = drawn.get(1, 0), drawn.get(0, 0)
    if not toxic or not clean:
        return Model(np.zeros(0, np.uint64))
    counts = some.repartition(8).mapInArrow(_spread, "hash long, toxic int, n long").groupBy("hash").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c"))
    rate = (F.col("t") / toxic) / (F.col("t") / toxic + F.col("c") / clean)
    rows = counts.filter((F.col("t") >= LEAST_DOCS) & (rate > 0.98)).orderBy(F.desc("t"), "hash").limit(CANDIDATES).collect()
    keys = np.sort(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in letters.blocks(batch.column(0)):
                parts: list[list[int]] = [[] for _ in range(j - i)]
                for h in _features(words, np.arange(len(words.start))):
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    for k in np.flatnonzero(keys[at] == h):
                        parts[words.doc[k]].append(int(at[k]))
                yield pa.RecordBatch.from_arrays([pa.array([sorted(set(p)) for p in parts], pa.list_(pa.int32()))], ["features"])

    cover = [np.array(r["features"], np.int64) for r in some.filter("toxic = 1").select("text").mapInArrow(incidence, "features array<int>").collect()] if len(keys) else []
    model = Model(keys[choose_insults(cover, len(keys))] if len(keys) else keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.events(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], ["events", "toxic"])

    seen = some.mapInArrow(count, "events binary, toxic int").groupBy("events", "toxic").count().collect()
    x = np.log2(1 + np.array([np.frombuffer(r["events"]) for r in seen]))
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    y = np.array([float(r["toxic"]) for r in seen])
    weight = np.array([r["count"] / share[r["toxic"]] for r in seen])
    model.weights = _logistic(x, y, weight, model.weights)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train: Column | None = None) -> DataFrame:
    """doc_id, score and predicted of every row of docs; labels (doc_id, toxic) under train teach."""
    spark = tuned(docs.sparkSession)
    condition = fold("doc_id", 5) != 0 if train is None else train
    known = labels.filter(condition & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known, share = sampled(known)
    # 3 * TRAIN_DOCS labels in expectation at any size; texts of other documents stay where they are
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    model = spark.sparkContext.broadcast(fit(taught, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")

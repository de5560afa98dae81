"""Learned operators: held-out accuracy, exact parts against brute force, and edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import language, language_model, quality, toxicity, wfst
from folioscan.llm.common import fold
from folioscan.llm.queries import queries

SF = "/root/testdata/sf0.01"


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_fold(spark):
    rows = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r["f"] == held(r["id"], 7) for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries()["op4_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(out) / len(out) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, edge, empty):
    rows = {r["doc_id"]: r for r in language.identify(edge, F.lit(True)).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert rows[10]["lang_pred"] == "fr" and rows[13]["lang_pred"] == "en"
    assert language.identify(empty).count() == 0
    nobody = language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nobody} == {"und"}
    kept = language.in_known_language(edge, train=F.lit(True))
    assert kept.columns == edge.columns and {1, 2, 3, 8}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_backoff_goes_to_shorter_grams(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("strasse strassen", "de"), ("strasse strassen", "de"), ("street streets", "en"), ("street streets", "en")])]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    import pyarrow as pa

    names, _ = model.predict(pa.array(["strassenbahn", "streetcar", "strasse", "gassen", "qqq"]))
    assert names[:4] == ["de", "en", "de", "de"] and names[4] in ("de", "en")


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = queries()["op3_quality_classifier"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.98


def test_quality_edges(spark, edge, empty, sf):
    labels = spark.createDataFrame([(4, 1), (9, 0), (13, 1), (None, 1), (14, None), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(edge, labels, train=F.lit(True)).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.good(edge, labels, train=F.lit(True)).columns == edge.columns


def test_isotonic_steps_ascend():
    got = quality.pool_adjacent_violators(np.array([1.0, 1, 2, 1]), np.array([0.1, 0.5, 0.2, 0.9]))
    assert got.tolist() == pytest.approx([0.1, 0.3, 0.3, 0.9])


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = queries()["op9_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= len(clean) * 0.005
    toxic = [r for r in rows if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > len(toxic) * 0.8  # this little sample doesn't show every stem


def test_grammar_reads_clauses():
    def events(classes):
        return {toxicity.EVENTS[i]: n for i, n in enumerate(toxicity.read_clause(classes)) if n}

    assert events("ooIo") == {"insult": 1} and events("PoI") == {"aimed insult": 1} and events("IoP") == {"aimed insult": 1}
    assert events("NoI") == {"negated": 1} and events("NooooI") == {"insult": 1} and events("RoPI") == {"reported": 1}
    assert events("T") == {"threat": 1} and events("TP") == {"aimed threat": 1} and events("oo") == {} and events("") == {}


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (13, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(edge, labels).collect()}
    assert rows[1]["predicted"] == 0 and rows[1]["score"] == rows[2]["score"]
    more = spark.createDataFrame([(1, "You idiot!"), (2, "You are no idiot."), (3, "Nice day."), (4, "Sie sagte: er ist nett.")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(more, labels.limit(0)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_shortest_path_of_a_composition():
    a, b = wfst.linear("ab"), wfst.Wfst(0, finals={0: 0.0})
    b.add(0, "a", "x", 2.0, 0)
    b.add(0, "a", "y", 1.0, 0)
    b.add(0, "b", wfst.EPSILON, 0.5, 0)
    assert wfst.shortest_path(wfst.compose(a, b)) == (1.5, ["y"])
    assert wfst.shortest_path(wfst.compose(wfst.linear("c"), b)) is None


def brute_counts(rows):
    tok = [[w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + ["\0"] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, tok) if held("" if d is None else d, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws in zip(rows, tok)]


@pytest.mark.parametrize("top", [1 << 18, 500])
def test_lm_counts_and_base_score(spark, sf, monkeypatch, top):
    """Also with few counts broadcast, so that many tokens are joined."""
    monkeypatch.setattr(language_model, "TOP", top)
    monkeypatch.setattr(language_model, "EPOCHS", 1)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries()["op2_lm_scoring"](spark, sf).collect()}
    for d, n, known, total, base in brute_counts(rows):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(d, 7) == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_is_normalised():
    m = language_model.Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 300, np.zeros(256))
    language_model.train(m, [np.random.default_rng(1).integers(0, 300, 400)])
    total = sum(10 ** m.log10_symbols(np.array([5, 7, w]), np.zeros(3, int))[2] for w in range(300))
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_edges(spark, edge, empty):
    got = language_model.score_texts(edge).collect()
    rows = {r[0]: r for r in brute_counts([(r["doc_id"], r["text"]) for r in edge.collect()])}
    for r in got:
        d, n, known, total, base = rows[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base)
    assert language_model.score_texts(empty).count() == 0
    none = language_model.score_texts(edge, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in none)


def test_lm_network_learns_from_all_training_rows(spark):
    """What follows what is said by a few texts only, wherever they lie; all others say nothing."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(10)]
    pairs = lambda: " ".join(f"{a} {a}x" for a in rng.choice(words, 75))
    mixed = lambda: " ".join(rng.permutation([*rng.choice(words, 75), *(f"{a}x" for a in rng.choice(words, 75))]))
    rows = [(i, pairs() if i % 3 else mixed()) for i in range(6000)]
    test = [(10_000 + i, t) for i, t in enumerate([*(pairs() for _ in range(20)), *(mixed() for _ in range(20))])]
    docs = spark.createDataFrame(rows + test, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, F.col("doc_id") < 10_000).filter("held_out").collect()}
    of = lambda first: sum(got[10_000 + i] for i in range(first, first + 20)) / 20
    assert of(0) > of(20) + 15


def test_lm_score_by_brute_force():
    """Scores of texts from parameters, symbol by symbol, with and without a table of normalisers."""
    rng = np.random.default_rng(6)
    m = language_model.Model(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 40, np.zeros(256))
    trainer = language_model.train(m, [rng.integers(0, 40, 3000)])
    symbol, doc = rng.integers(0, 40, 60), np.repeat([0, 1, 2], [10, 1, 49])
    want = []
    for i, w in enumerate(symbol):
        at = int(np.searchsorted(doc, doc[i]))
        a, b = symbol[i - 1] if i > at else 40, symbol[i - 2] if i > at + 1 else 40
        logits = (m.left[a].astype(float) + m.right[b]) @ m.out.T + m.bias
        want.append((logits[w] - math.log(np.exp(logits).sum())) / math.log(10))
    assert m.log10_symbols(symbol, doc) == pytest.approx(want, abs=1e-5) and trainer.x[0].shape == (41, language_model.WIDTH)
    one, two = m.contexts(symbol, doc)
    assert m._normalisers(one, two) == pytest.approx(m.log_normalisers(one, two), abs=1e-5)


def test_lm_symbols_grow_with_the_vocabulary():
    assert language_model.symbol_counts(1000) == language_model.symbol_counts(400_000) == (768, 256)
    assert language_model.symbol_counts(3_200_000) == (1536, 512) and language_model.symbol_counts(400_000_000) == (7680, 2048)


def test_language_learns_rare_languages_and_more_than_500(spark, monkeypatch):
    """A language with four texts among many, whose words are rarer than the tables' commonest entries; 600 languages."""
    monkeypatch.setattr(language, "TRAIN_DOCS", 50)
    monkeypatch.setattr(language, "WORDS", 20)
    monkeypatch.setattr(language, "GRAMS", 20)
    words = ["haus", "baum", "wald", "berg", "fluss", "strasse", "garten", "himmel"]
    rows = [(i, " ".join(words), "de") for i in range(3000)] + [(5000 + i, "talo puu metsä vuori joki", "fi") for i in range(4)]
    docs = spark.createDataFrame([*rows, (9000, "metsä vuori talo", None), (9001, "wald berg", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, F.lit(True)).filter("doc_id >= 9000").collect()}
    assert got == {9000: "fi", 9001: "de"}
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}") * 2
    many = [(i, " ".join([name(i // 2)] * 3), f"x{i // 2:03d}") for i in range(1200)]
    rows = language.identify(spark.createDataFrame(many, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert all(r["lang_pred"] == f"x{r['doc_id'] // 2:03d}" for r in rows)

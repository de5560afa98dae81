"""Exact copies and n-gram links against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import exact_dedup, ngram_join
from folioscan.llm.components import components, local_components
from folioscan.llm.queries import oracle_sql, queries


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_groups(rows, n, percent):
    """(set size, least id of the component) of each row (doc_id, text), by all pairs."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", lower(t)) if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return [(d, len(s), least.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label)]


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, span in ((0, 1 << 40), (1, 1 << 54), (500, 1 << 54), (300, 300), (1000, 1 << 20)):
        v = np.sort(rng.integers(0, span, n, dtype=np.uint64))
        assert exact_dedup.decode(exact_dedup.encode(v, span), n, span).tolist() == v.tolist()


def test_exact_dedup_matches_sql(spark, sf, duck):
    name = "op6_exact_dedup"
    got = queries()[name](spark, sf).toPandas()
    want = duck.sql(oracle_sql()[name]).df()[got.columns]
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want.sort_values(key).reset_index(drop=True).astype(str))


def test_exact_dedup_edges(edge, empty):
    rows = exact_dedup.exact_dedup(edge).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == edge.count()
    assert by[1][0]["keep_id"] == by[2][0]["keep_id"] == 2 and by[2][0]["kept"] and not by[1][0]["kept"]  # null is empty
    assert by[4][0]["keep_id"] == 5 and by[5][0]["group_size"] == 3 and by[None][0]["keep_id"] == 5 and not by[None][0]["kept"]
    assert sorted(r["kept"] for r in by[11]) == [False, True] and by[11][0]["group_size"] == 2  # repeated rows: one stays
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.deduplicated(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id = 11").count() == 1 and kept.filter("doc_id = 4").count() == 0


#: Ids with two texts, null ids, rows that repeat both.
SHARED_IDS = [(11, "a"), (11, "b"), (20, "b"), (None, "b"), (None, "c"), (30, "c"), (40, "d"), (40, "d"), (None, "e"), (None, "e"), (None, "f"), (50, None), (51, "")]


def test_deduplicated_keeps_exactly_one_row_of_each_text(spark):
    docs = spark.createDataFrame(SHARED_IDS, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    order = lambda r: (r[1] or "", r[0] or 0)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == [(51, ""), (11, "a"), (20, "b"), (30, "c"), (40, "d"), (None, "e"), (None, "f")]


def test_one_of_each_keeps_exactly_one_row_of_each_component(spark):
    """An id whose other text is unlike stays with it; null ids and repeated rows go like any other."""
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(60))
    rows = [(3, text), (7, near), (7, other), (None, near), (None, text + " y"), (9, "one"), (9, "one"), (None, "two"), (None, "two"), (None, "three four"), (12, ""), (13, None)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(3, text), (7, other), (9, "one"), (None, "two"), (None, "three four"), (12, ""), (13, None)]))


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_words_of_few_letters_stay_apart(spark):
    for n in (1024, 4096):
        x, y = thue_morse(n), thue_morse(n, "ba")
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("rows,shingles", [(4096, 4_000_000), (9, 300)])
def test_ngram_join_with_a_shingle_in_all_sets(spark, monkeypatch, rows, shingles):
    """Every set holds the same shingles and little else, so that prefixes meet there: groups fuse although few link."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", shingles)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    data = []
    for k in range(60):
        own = [f"o{rng.randrange(6)}" for _ in range(rng.randint(0, 6))]
        data.append((k, " ".join(common[: rng.randint(6, 12)] + own)))
    got = ngram_join.ngram_join(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 5, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(data, 5, 80))


def test_ngram_join_matches_brute_force_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op1_ngram_jaccard_join"](spark, sf).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(rows, 4, 85))


@pytest.mark.parametrize("rows,shingles", [(4096, 4_000_000), (7, 200)])
def test_ngram_join_of_edited_copies(spark, monkeypatch, rows, shingles):
    """Groups of edited copies, whole and cut into blocks."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", shingles)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    data = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            data.append((len(data), " ".join(copy)))
    got = ngram_join.ngram_join(spark.createDataFrame(data, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_groups(data, 5, 80))


def test_ngram_join_edges(edge, empty):
    got = ngram_join.ngram_join(edge, 5, 80).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=order) == sorted(brute_groups(rows, 5, 80), key=order)
    assert ngram_join.ngram_join(empty).count() == 0
    assert ngram_join.one_of_each(edge).columns == edge.columns


def test_tokens_code_round_trip():
    for width in (53, 44, 36):
        v = np.sort(np.random.default_rng(2).integers(0, 1 << width, 3000, dtype=np.uint64))
        assert ngram_join.decode_tokens(ngram_join.code_tokens(v, width), ngram_join.low_bytes(v)).tolist() == v.tolist()


def test_exchange_grows_with_the_input():
    """Owners and chunks grow together: a message keeps its shingles, and owners hold no more than the root needs."""
    for shingles in (10**6, 10**8, 10**11, 16 * 10**12):
        bits, chunk = ngram_join.exchange_sizes(shingles)
        assert chunk >> bits >= ngram_join.MESSAGE / 4 and shingles >> bits <= 4 * max(ngram_join.OWNER_SHINGLES, 2 * chunk)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    nodes, roots = local_components(*(np.array(x) for x in zip(*pairs)))
    assert dict(zip(nodes.tolist(), roots.tolist())) == label
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in label} == label

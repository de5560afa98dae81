"""The pipeline's stages against a plain recomputation of their decisions."""

import corpus_pipeline as P
from folioscan.llm import exact_dedup, language, ngram_join, quality
from folioscan.llm.common import stored

from .test_duplicates import brute_groups, lower

SF = "/root/testdata/sf0.01"


def test_stages_decide_and_keep_columns(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["language id", "quality classifier", "exact dedup", "ngram jaccard join", "packing"]
    for name, stage in P.STAGES:
        before, after = docs, stored(stage(spark, docs, SF), "stage")
        if name == "packing":
            assert {r[0] for r in after.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
            continue
        assert after.columns == columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "language id":
            want = {r["doc_id"] for r in language.identify(before).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
        elif name == "quality classifier":
            want = {r["doc_id"] for r in quality.classify(before, labels).collect() if r["predicted"]}
            clean = {r["doc_id"] for r in labels.filter("quality = 1").collect()} & {r["doc_id"] for r in before.select("doc_id").collect()}
            assert len(clean - ids) <= len(clean) * 0.02
        elif name == "exact dedup":
            keep = {}
            for r in before.collect():
                keep[lower(r["text"])] = max(keep.get(lower(r["text"]), r["doc_id"]), r["doc_id"])
            want = set(keep.values())
        else:
            want = {c for _, _, c in brute_groups([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)}
        assert ids == want, name
        docs = after


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_stages_on_odd_rows(spark, edge, empty, sf):
    for rows in (edge, empty):
        kept = exact_dedup.deduplicated(rows)
        assert ngram_join.one_of_each(kept).columns == rows.columns
    for _, stage in P.STAGES[:4]:
        assert stage(spark, empty, sf).columns == empty.columns and stage(spark, empty, sf).count() == 0

"""Scalars, predicates and relational patterns on small frames."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import predicates as P
from folioscan.functions import text as T
from folioscan.functions import units as U
from folioscan.operators import gates, integrity, layout, planning, repair, rules, venues
from folioscan.operators import relational as R
from folioscan.operators.locations import canonical_path, element_id, find, invalid_location, location, parse_element_id
from folioscan.sources import artifacts


def values(spark, data, column, schema="x string"):
    rows = spark.createDataFrame([(d if isinstance(d, tuple) else (d,)) for d in data], schema).coalesce(1)
    return [r[0] for r in rows.select(column).collect()]


def test_units(spark):
    assert values(spark, ["12.25", "0.025", "-0.025"], U.twips_from_points(F.col("x"))) == [245, 1, -1]
    assert values(spark, ["1", "2.54"], U.twips_from_centimetres(F.col("x"))) == [567, 1440]
    assert values(spark, [245, 240], U.half_points(F.col("x")), "x long") == [None, "24"]
    assert values(spark, ["24", "0", "x", "-2"], U.half_point_size(F.col("x"))) == [240, None, None, None]
    assert values(spark, [(100, 2), (12240, 2)], U.column_width(F.col("x"), F.lit(720), F.lit(720), F.col("n"), F.lit(360)), "x long, n int") == [1, 5220]
    with pytest.raises(Exception, match="positive"):
        values(spark, ["0"], U.line_multiple(F.col("x")))


def test_numerals_and_captions(spark):
    assert values(spark, ["XIV", "iix", "IC", "", "A", "MCMXC"], T.roman_number(F.col("x"))) == [14, 10, 99, None, None, 1990]
    data = [("Fig. 12. x", "FigureCaption"), ("  Table IV. x", "TableCaption"), ("Table 7: x", "TableCaption"), ("TABLE", "TableCaption"), ("Figure", "FigureCaption"), ("Table A9", "TableCaption")]
    assert values(spark, data, T.caption_number(F.col("x"), F.col("t")), "x string, t string") == [12, 4, 7, None, None, None]


def test_text(spark):
    assert values(spark, ["Héading 1!"], T.style_token(F.col("x"))) == ["héading1"]
    assert values(spark, [(["a", "", "b;c"],)], T.encode_sequence(F.col("x")), "x array<string>") == ["1:a;0:;3:b;c;"]
    assert values(spark, ["  e\u0301 \u00a0 x "], T.normal_space(F.col("x"))) == ["é x"]
    assert values(spark, ["Ação  Ｘ-1", None], T.venue_key(F.col("x"))) == ["ac a o x 1", None]
    assert values(spark, [" A  ﬁ ", None], T.identity_key(F.col("x"))) == ["a fi", None]
    assert values(spark, ["d/page-3.png"], T.page_number(F.col("x"))) == [3]
    assert values(spark, ["a\x00b" + "c" * 300], F.length(T.printable(F.col("x")))) == [200]
    assert values(spark, ["2024-02-30", "2024-02-29", "x"], T.is_iso_date(F.col("x"))) == [False, True, False]
    assert values(spark, ["<a&'\">"], T.html_escape(F.col("x"))) == ["&lt;a&amp;&#39;&quot;&gt;"]


def test_predicates(spark):
    tests = {
        P.is_heading1: {"IV. Results": True, "iv.x": True, "IIIIIIII. x": False, "I.": False, "I. 12": False}, P.is_heading2: {"A. x": True, "A.x": False, "A. ": False, "1. x": False}, P.is_heading3: {"12) x": True, "1234) x": False, "1)": False, ") x": False},
        P.is_reference_entry: {"[1] x": True, "  [9]": True, "[x]": False, "[1": False}, P.is_references_heading: {" References ": True, "参考文献": True, "References:": False}, P.is_figure_caption: {" fig. 1": True, "图 1": True, "Fi": False},
        P.is_keywords: {"INDEX TERMS - a": True, "关键词": True, "words": False}, P.is_unsafe_path: {"": True, "/x": True, "C:\\x": True, "a/../b": True, "a..b": False, "..": True, None: True, "word/document.xml": False},
    }
    for f, cases in tests.items():
        assert values(spark, list(cases), f(F.col("x"))) == list(cases.values()), f.__name__
    ratio = [(0, 0), (1, 0), (1000, 10), (1001, 10), (None, 1)]
    assert values(spark, ratio, P.exceeds_ratio(F.col("a"), F.col("b")), "a long, b long") == [False, True, False, True, False]
    same = [("FontAscii", "text:ARIAL", "text:Arial"), ("ParagraphStyleId", "text:A", "text:a"), ("Bold", None, "bool:True")]
    assert values(spark, same, P.values_equal(F.col("p"), F.col("a"), F.col("b")), "p string, a string, b string") == [True, False, False]


def test_locations(spark):
    row = spark.range(1).select(location(section_ix=F.lit(0), para_ix=F.lit(3), rel=F.lit("r 1")).alias("l"), location(F.lit("header"), part_ix=F.lit(2)).alias("h"), location(row_ix=F.lit(1)).alias("bad"))
    got = row.select(canonical_path(F.col("l")), element_id(F.col("h")), invalid_location(F.col("bad")), invalid_location(F.col("l"))).first()
    assert tuple(got) == ("main/section[0]/paragraph[3]/relationship[r%201]", "element:header[2]", "row_without_table", None)
    assert values(spark, ["element:main/section[1]/paragraph[12]"], parse_element_id(F.col("x")))[0].asDict() == {"section_ix": 1, "para_ix": 12}
    with pytest.raises(Exception, match="not a body paragraph"):
        values(spark, ["element:main/section[1]/table[0]"], parse_element_id(F.col("x")))
    elements = spark.createDataFrame([(1, "a", "Body"), (1, "b", "Title")], "doc_id long, path string, kind string")
    assert find(elements, elements, "Body").count() == 1


def test_modal_prefers_null_then_smaller(spark):
    df = spark.createDataFrame([(1, None), (1, "b"), (2, "b"), (2, "a"), (2, "b")], "k int, v string")
    assert {(r["k"], r["v"], r["n"], r["tie"]) for r in R.modal(df, ["k"], "v").collect()} == {(1, None, 1, True), (2, "b", 2, False)}


def test_runs_sections_totals(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabaaab")], "k int, i int, c string")
    assert R.longest_run(df, ["k"], "i", F.col("c") == "a").first()["longest"] == 3
    assert [(r["section_ix"], r["place"]) for r in R.sections(df, ["k"], "i", F.col("c") == "b").orderBy("i").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]
    big = spark.createDataFrame([(1, 0, 2**62), (1, 1, 2**62), (1, 2, 5)], "k int, i int, v long")
    assert [r["total"] for r in R.running_total(big, ["k"], ["i"], "v").orderBy("i").collect()] == [2**62, 2**63 - 1, 2**63 - 1]
    assert R.next_after(df, ["k"], "i", F.col("c") == "b").first()["i"] == 3


def test_multisets_and_subsets(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("aab", "ab"))
    assert [r["x"] for r in R.multiset_surplus(a, b).collect()] == ["a"] and R.multiset_contained(b, a) and not R.multiset_contained(a, b)
    assert R.not_subset(a, b, "x").isEmpty()


def test_topological_order_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "n string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "n string, needs string")
    assert {r["n"]: r["round"] for r in R.topological_levels(nodes, edges, "n", "needs").collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "n string, up string")
    got = {(r["node"], r["ancestor"], r["depth"]) for r in R.closure(edges, "n", "up", 8).collect()}
    assert {("a", "c", 2), ("a", "a", 0), ("x", "y", 1), ("x", "x", 0)} <= got and len(got) == 10


def test_overrides(spark):
    package = rules.builtin_rules(spark)
    edits = spark.createDataFrame([("ieee-like-v1.page.column-count", "int:1", None), ("ieee-like-v1.title.bold", None, False)], "rule_id string, expected string, enabled boolean")
    got = {r["rule_id"]: r for r in rules.override_rules(package, edits).collect()}
    assert got["ieee-like-v1.page.column-count"]["expected"] == "int:1" and not got["ieee-like-v1.title.bold"]["enabled"] and len(got) == 179
    for bad, message in (([("x", None, True)], "unknown rule"), ([("ieee-like-v1.title.bold", None, True)] * 2, "repeated edit")):
        with pytest.raises(Exception, match=message):
            rules.override_rules(package, spark.createDataFrame(bad, edits.schema)).collect()
    assert rules.rule_errors(package).isEmpty()
    assert {r["error"] for r in rules.rule_errors(package.withColumn("expected", F.lit("int:1"))).collect()} == {"value_kind"}


def test_ambiguous_template_pages(spark):
    rows = [(1, 0, "ColumnCount", "int:1"), (1, 1, "ColumnCount", "int:2"), (1, 0, "PageWidth", "twip:5"), (1, 1, "PageWidth", None), (1, 0, "MarginTop", None), (1, 1, "MarginTop", None)]
    made, notices = rules.page_rules(spark.createDataFrame(rows, "doc_id long, section_ix int, property string, value string"))
    assert [(r["property"], float(r["confidence"]), r["needs_confirmation"]) for r in made.collect()] == [("PageWidth", 0.75, True)]
    assert {r["code"] for r in notices.collect()} == {"template.page.column-count.ambiguous", "template.page.margin-top.missing"}


def test_layout_policy(spark):
    schema = "doc_id long, operation_id string, kind string, decision string, risk string, rollback string, depends_on array<string>, after_element_id string, section_ix int, columns int, gap_tw long, object_id string, strategy string"
    rows = [(1, "a", "SetSectionColumns", "Apply", "Low", "discardCandidateCopy", [], None, 1, 2, 360, None, None), (1, "b", "PreserveFullWidthObject", "Apply", "Low", "odd", ["a"], None, None, None, None, "t", "s"), (1, "c", "SetSectionColumns", "ReportOnly", "Blocked", "discardCandidateCopy", ["b"], None, 0, 9, 9000, None, None)]
    ops = planning.layout_operations(spark.createDataFrame(rows, schema), seen=True)
    got = {r["operation_id"]: (r["decision"], r["risk"], r["level"], r["rollback"]) for r in ops.collect()}
    assert got == {"a": ("Apply", "Medium", "Review", "discardCandidateCopy"), "b": ("Preserve", "High", "Experimental", "discardCandidateCopy"), "c": ("ReportOnly", "Blocked", "Experimental", "discardCandidateCopy")}
    assert {(r["operation_id"], r["error"]) for r in planning.layout_errors(ops).collect()} == {("c", "columns"), ("c", "gap")}
    assert [r["operation_id"] for r in planning.ordered_layout(ops).orderBy("execution_order").collect()] == ["a", "b", "c"]
    assert [r["operation_id"] for r in gates.experimental_only(ops.select("operation_id"), ops).collect()] == ["a"]


def test_section_break(spark):
    sections = spark.createDataFrame([(1, 0, 1, 0, None)], "doc_id long, section_ix int, columns int, gap_tw long, start string")
    after = layout.set_columns(layout.insert_break(sections, spark.createDataFrame([(1, "continuous")], "doc_id long, start string")), spark.createDataFrame([(1, 1, 2, 360)], "doc_id long, section_ix int, columns int, gap_tw long"))
    assert [(r["section_ix"], r["columns"], r["gap_tw"], r["start"]) for r in after.orderBy("section_ix").collect()] == [(0, 1, 0, None), (1, 2, 360, "continuous")]
    ok = layout.layout_matches(sections, after, spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([(1, 1, 2, 360)], "doc_id long, section_ix int, columns int, gap_tw long"))
    assert ok.first()["matches"]


def test_gates(spark, tmp_path):
    flags = {c: True for c, _ in gates.REASONS}
    rows = spark.createDataFrame([tuple(flags.values()), tuple({**flags, "post_check_passed": False, "pages_passed": None}.values())], ", ".join(f"{c} boolean" for c in flags))
    got = gates.validate_output(rows).collect()
    assert got[0]["ready"] and got[1]["reasons"] == ["errors_left", "blocking_pages"]
    status = [("Passed", True, None), ("Passed", False, "High"), ("Passed", None, "Low"), ("Failed", True, None)]
    assert values(spark, status, gates.review_status(F.col("s"), F.col("b"), F.col("r")), "s string, b boolean, r string") == ["NeedsReview", "NeedsReview", "Passed", "Failed"]
    one = spark.createDataFrame([(1, True)], "doc_id long, ok boolean")
    assert repair.promote({"x": one}, one, str(tmp_path / "out")) and not repair.promote({"x": one}, one.withColumn("ok", F.lit(False)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_integrity_roll_up(spark):
    df = spark.createDataFrame([(1, "Passed"), (1, "NeedsConfirmation"), (2, "Failed"), (2, "Passed"), (3, "Passed")], "d int, s string")
    assert {r["d"]: r["x"] for r in df.groupBy("d").agg(integrity.roll_up(F.col("s")).alias("x")).collect()} == {1: "NeedsConfirmation", 2: "Failed", 3: "Passed"}


def test_venues(spark, tmp_path):
    import json

    (tmp_path / "v.json").write_text(json.dumps({"schemaVersion": "1.0", "families": [{"id": "security", "displayName": "Security venues", "aliases": ["CCS", "ACM CCS"]}, {"id": "acm", "displayName": "ACM", "aliases": ["ACM journals"]}]}))
    aliases, names = artifacts.read_venues(spark, str(tmp_path / "v.json"))
    queries = spark.createDataFrame([(1, "acm ccs 2027 main track"), (2, "journals of nothing"), (3, "zzz")], "query int, q string")
    got = {(r["query"], r["status"], r["family"]) for r in venues.route(queries, aliases, names).collect()}
    assert got == {(1, "resolved", "security"), (2, "needs_verification", "acm")}
    (tmp_path / "w.json").write_text(json.dumps({"families": [{"id": "a", "displayName": "X", "aliases": []}, {"id": "b", "displayName": "x", "aliases": []}]}))
    with pytest.raises(Exception, match="duplicate alias"):
        artifacts.read_venues(spark, str(tmp_path / "w.json"))[0].collect()


def test_templates(spark, tmp_path):
    import json

    identity = {"venue": "V", "publisherOrSociety": "P", "yearOrVolume": "2027", "trackOrArticleType": "main", "submissionStage": "review", "templateVersion": "1"}
    good = {"id": "v-2027", "displayName": "V", "format": "docx", "rulePolicy": "derive-at-runtime", "identity": identity, "artifact": {"path": "v.docx", "sha256": "a" * 64}, "provenance": {"kind": "official-download", "originalFileName": "v", "sourceUrl": None, "receivedOrRetrieved": "2026-01-02"}, "governance": {"status": "validated", "selectionMode": "exact-identity", "distributionScope": "x", "licenseStatus": "x", "requiresOnlineFreshnessCheck": True}}
    bad = {**good, "id": "Bad Id", "artifact": {"path": "../v.docx", "sha256": "zz"}, "provenance": {**good["provenance"], "sourceUrl": "ftp://x", "receivedOrRetrieved": "2026-13-01"}}
    (tmp_path / "t.json").write_text(json.dumps({"schemaVersion": "1.0", "templates": [good, bad]}))
    files = spark.createDataFrame([("v.docx", "a" * 64, True)], "name string, sha256 string, is_package boolean")
    registry = artifacts.read_templates(spark, str(tmp_path / "t.json"), files)
    errors = {r["template_id"]: set(r["errors"]) for r in registry.collect()}
    assert errors["v-2027"] == set() and errors["Bad Id"] == {"id", "sha256", "missing_file", "path_escapes", "source_url", "date"}
    schema = "request int, format string, venue string, publisher string, year string, track string, stage string, template_version string"
    asked = spark.createDataFrame([(1, "docx", " v ", "p", "2027", "MAIN", "review", "1"), (2, "docx", "v", "p", "2026", "main", "review", "1"), (3, "docx", "v", "p", None, "main", "review", "1")], schema)
    got = {r["request"]: r["status"] for r in venues.resolve_templates(asked, registry.filter("template_id = 'v-2027'")).collect()}
    assert got == {1: "resolved", 2: "needs_exact_template", 3: "invalid_identity"}


def test_strict_artifacts(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"doc_id":1,"group_id":"g","decision":"Apply","risk":"Low","confidence":0.9,"source_sha256":"' + "a" * 64 + '"}\n')
    assert artifacts.read_artifact(spark, "proposal", str(tmp_path / "p.json")).count() == 1
    for name, line in (("q", '{"doc_id":1}'), ("r", "not json")):
        (tmp_path / f"{name}.json").write_text(line + "\n")
        with pytest.raises(Exception):  # noqa: B017
            artifacts.read_artifact(spark, "proposal", str(tmp_path / f"{name}.json")).collect()


def test_classes_by_row_equal_those_of_the_long_table(spark, sf):
    from folioscan.operators import classify
    from folioscan.sources.manuscript import manuscript

    rows = manuscript(spark.read.parquet(f"{sf}/documents.parquet"))
    columns = ["doc_id", "path", "kind", "confidence", "status", "reasons"]
    by_row = classify.classify(rows).filter(F.size("reasons") > 0).select(*columns)
    long = classify.decide(classify.candidates(classify.evidence(classify.in_context(rows)))).select(*columns)
    assert by_row.exceptAll(long).isEmpty() and by_row.count() == long.count() > 0

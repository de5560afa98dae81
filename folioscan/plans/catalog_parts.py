"""More queries: scalars, rule packages, plans and gates, repairs, layout, sets, inherited formatting, artifacts.

As in the catalog, operators are bound to columns of the driver's tables, each with its SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import predicates as P
from folioscan.functions import text as T
from folioscan.functions import units as U
from folioscan.operators import check as C
from folioscan.operators import gates, integrity, layout, locations, pages, planning, repair, rules, styles, venues
from folioscan.operators import relational as R
from folioscan.operators.locations import canonical_path, location
from folioscan.sinks import artifacts as sinks
from folioscan.sinks import packages
from folioscan.sources import artifacts, docx, generate, png

from . import classify_sql as Q
from .catalog import _SHEETS, _elements, _observed, _part_styles, query, read
from .staging import stage_path, staged


def pick(names: list, at: Column) -> Column:
    """names[at]"""
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def sql_pick(names: list, at: str) -> str:
    return "[" + ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names) + f"][{at} + 1]"


def K() -> Column:
    return F.col("p_partkey")


_DATES, _URLS = ["2024-02-29", "2023-02-29", "2024-2-9", "x"], [None, "https://a.b/c", "ftp://a", "http://"]
_SLUGS, _FILES = ["PageWidth", "Heading1", "FigureCaption"], ["a.docx", "A.DOTX", "a.doc", "docx"]
_BACK, _TOUCH = ["discardCandidateCopy", "restoreSectionSnapshot", "undo"], ["PageWidth", "Bold", "ParagraphStyleId", "ColumnCount"]
_KEYS = ["twip:240", "bool:True", "bool:False", "text:Body", None]


@query(f"""SELECT p_partkey, p_name || ' ' || p_brand AS spaced, left(p_name || chr(65533) || repeat('x', p_partkey % 300), 200) AS clean, p_partkey % 2 = 0 AS sha, p_partkey % 4 = 0 AS is_date, p_partkey % 4 < 2 AS is_url,
    lower(p_name) || ' e ' || lower(replace(p_brand, '#', ' ')) AS venue, CAST(p_partkey % 50 + 1 AS INTEGER) AS page, '&lt;' || p_brand || '&amp;&quot;&#39;&gt;' AS html, {sql_pick(["page-width", "heading-1", "figure-caption"], "p_partkey % 3")} AS slug,
    CAST(CASE WHEN p_size > 10 THEN (p_size - 10) * 10 END AS BIGINT) AS half, greatest(0, least(1, (p_size - 25) / 20.0::DOUBLE)) AS unit, p_partkey % 2 = 1 AS zip, p_partkey % 4 < 2 AS word, p_partkey % 3 < 2 AS undo, p_partkey % 4 IN (0, 2) AS moves,
    CAST(p_partkey % 7 AS INTEGER) AS section_ix, CAST(p_partkey AS INTEGER) AS para_ix, {sql_pick(["12.00 pt", "yes", "no", "Body", "unknown"], "p_partkey % 5")} AS shown FROM part""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars over text, keys and lengths."""
    name, brand = F.col("p_name"), F.col("p_brand")
    digest = F.sha2(name, 256)
    parsed = locations.parse_element_id(F.concat(F.lit("element:main/section["), (K() % 7).cast("string"), F.lit("]/paragraph["), K().cast("string"), F.lit("]")))
    signature = F.when(K() % 2 == 1, F.unhex(F.lit("504B0304AA"))).otherwise(F.lit("PKxx").cast("binary"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", T.normal_space(F.concat(F.lit("  "), name, F.lit(" \t "), brand, F.lit("\n"))).alias("spaced"), T.printable(F.concat(name, F.lit("\x01"), F.repeat(F.lit("x"), (K() % 300).cast("int")))).alias("clean"),
        T.is_sha256(F.when(K() % 2 == 0, digest).otherwise(F.concat(F.lit("G"), F.substring(digest, 2, 63)))).alias("sha"), T.is_iso_date(pick(_DATES, K() % 4)).alias("is_date"), T.is_web_url(pick(_URLS, K() % 4)).alias("is_url"),
        T.venue_key(F.concat(name, F.lit(" É"), brand)).alias("venue"), T.page_number(F.concat(F.lit("d-7/page-"), (K() % 50 + 1).cast("string"), F.lit(".png"))).alias("page"), T.html_escape(F.concat(F.lit("<"), brand, F.lit("&\"'>"))).alias("html"),
        rules.slug_column(pick(_SLUGS, K() % 3)).alias("slug"), U.half_point_size((F.col("p_size") - 10).cast("string")).alias("half"), U.unit_interval((F.col("p_size") - 25) / F.lit(20.0)).cast("double").alias("unit"), P.has_zip_signature(signature).alias("zip"),
        P.is_word_package(pick(_FILES, K() % 4)).alias("word"), P.is_rollback(pick(_BACK, K() % 3)).alias("undo"), P.is_layout_affecting(pick(_TOUCH, K() % 4)).alias("moves"), parsed["section_ix"].alias("section_ix"), parsed["para_ix"].alias("para_ix"),
        sinks.display(pick(_KEYS, K() % 5)).alias("shown"),
    )


_TARGETS, _PROPS, _EXPECTED = ["Body", "Page", "Nowhere"], ["FontSize", "Bold", "PageOrientation"], ["twip:1", "bool:True", "orientation:Portrait", "text:x"]


@query(f"""WITH r AS (SELECT 'p' || p_partkey % 20 AS package_id, 'r' || p_partkey % 1500 AS rule_id, {sql_pick(_TARGETS, "p_partkey % 3")} AS target, {sql_pick(["twip", "bool", "orientation"], "p_partkey % 3")} AS kind,
        split_part({sql_pick(_EXPECTED, "p_partkey % 4")}, ':', 1) AS got, (p_partkey % 6) * 25 - 25 AS confidence FROM part)
    SELECT rule_id, error, count(*) AS n FROM (SELECT rule_id, 'duplicate_rule_id' AS error FROM r GROUP BY package_id, rule_id HAVING count(*) > 1 UNION ALL SELECT rule_id, 'value_kind' FROM r WHERE got <> kind
        UNION ALL SELECT rule_id, 'confidence' FROM r WHERE confidence < 0 OR confidence > 100 UNION ALL SELECT rule_id, 'target' FROM r WHERE target = 'Nowhere') GROUP BY ALL""")
def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of rule packages."""
    made = read(spark, sf_dir, "part").select(F.format_string("p%d", K() % 20).alias("package_id"), F.format_string("r%d", K() % 1500).alias("rule_id"), pick(_TARGETS, K() % 3).alias("target"), pick(_PROPS, K() % 3).alias("property"), pick(_EXPECTED, K() % 4).alias("expected"), ((K() % 6) * 0.25 - 0.25).alias("confidence"))
    return rules.rule_errors(made).groupBy("rule_id", "error").agg(F.count("*").alias("n"))


_KINDS = ["InsertContinuousSectionBreak", "SetSectionColumns", "PreserveFullWidthObject", "SetSectionColumns"]
_DECIDED, _RISKS = ["Apply", "Apply", "ReportOnly"], ["Low", "Medium", "High", "Blocked"]


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = K() % 64
    needs = F.when((place > 0) & (place % 2 == 0), F.array(F.format_string("o%02d", F.floor(place / 2)))).when(K() % 97 == 0, F.array(F.format_string("o%02d", place))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "part").select(
        F.floor(K() / 64).alias("doc_id"), F.format_string("o%02d", place).alias("operation_id"), pick(_KINDS, K() % 4).alias("kind"), pick(_DECIDED, K() % 3).alias("decision"), pick(_RISKS, F.floor(K() / 4) % 4).alias("risk"),
        F.when(K() % 5 != 0, F.lit("element:x")).alias("after_element_id"), (K() % 6 - 1).cast("int").alias("section_ix"), (K() % 7).cast("int").alias("columns"), ((K() % 4) * 1000).alias("gap_tw"), F.when(K() % 3 != 0, F.lit("t")).alias("object_id"), F.lit("keep").alias("strategy"),
        F.when(K() % 2 == 0, F.lit("preserveOriginalPackage")).otherwise("odd").alias("rollback"), needs.alias("depends_on"),
    )


_OPERATIONS = f"""o AS (SELECT p_partkey AS k, p_partkey // 64 AS doc_id, p_partkey % 64 AS place, printf('o%02d', p_partkey % 64) AS operation_id, {sql_pick(_KINDS, "p_partkey % 4")} AS kind, {sql_pick(_DECIDED, "p_partkey % 3")} AS d0,
        {sql_pick(_RISKS, "p_partkey // 4 % 4")} AS r0, p_partkey // 4 % 4 + 1 AS rank FROM part),
    p AS (SELECT *, kind = 'PreserveFullWidthObject' AS wide, d0 = 'Apply' AS apply FROM o),
    q AS (SELECT *, CASE WHEN wide AND apply THEN 'Preserve' WHEN NOT wide AND NOT apply THEN 'ReportOnly' ELSE d0 END AS decision, [{", ".join(f"'{r}'" for r in _RISKS)}][greatest(rank, CASE WHEN wide OR NOT apply THEN 3 ELSE 2 END)] AS risk,
        CASE WHEN wide OR NOT apply THEN 'Experimental' ELSE 'Review' END AS level FROM p)"""


@query(f"""WITH {_OPERATIONS} SELECT doc_id, operation_id, decision, risk, level, level = 'Review' AS requires_confirmation, CASE WHEN k % 2 = 0 THEN 'preserveOriginalPackage' ELSE 'discardCandidateCopy' END AS rollback FROM q""")
def layout_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout proposals under policy."""
    return planning.layout_operations(_operations(spark, sf_dir), True).select("doc_id", "operation_id", "decision", "risk", "level", "requires_confirmation", "rollback")


@query(f"""WITH {_OPERATIONS}, c AS (SELECT *, kind LIKE 'Insert%' AS brk, kind = 'SetSectionColumns' AS col FROM q)
    SELECT operation_id, error, count(*) AS n FROM (SELECT operation_id, 'self_dependency' AS error FROM c WHERE k % 97 = 0 AND (place % 2 = 1 OR place = 0)
        UNION ALL SELECT operation_id, 'missing_boundary' FROM c WHERE brk AND k % 5 = 0 UNION ALL SELECT operation_id, 'section' FROM c WHERE col AND k % 6 = 0 UNION ALL SELECT operation_id, 'columns' FROM c WHERE col AND k % 7 NOT BETWEEN 1 AND 4
        UNION ALL SELECT operation_id, 'gap' FROM c WHERE col AND k % 4 = 3 UNION ALL SELECT operation_id, 'missing_object' FROM c WHERE wide AND k % 3 = 0) GROUP BY ALL""")
def layout_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that layout operations may not have."""
    return planning.layout_errors(planning.layout_operations(_operations(spark, sf_dir), True)).groupBy("operation_id", "error").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_OPERATIONS}, e AS (SELECT k, doc_id, place, CASE WHEN place > 0 AND place % 2 = 0 THEN place // 2 WHEN k % 97 = 0 THEN place END AS need FROM q),
    x AS (SELECT e.k, e.doc_id, e.place, CASE WHEN e.need IS NULL THEN NULL ELSE n.place END AS need, e.need IS NOT NULL AND n.k IS NULL AS lost FROM e LEFT JOIN e n ON n.doc_id = e.doc_id AND n.place = e.need),
    d(k, doc_id, place, round) AS (SELECT k, doc_id, place, 0 FROM x WHERE need IS NULL AND NOT lost UNION ALL SELECT x.k, x.doc_id, x.place, d.round + 1 FROM x JOIN d ON x.doc_id = d.doc_id AND x.need = d.place)
    SELECT q.doc_id, operation_id, CAST(CASE WHEN round IS NOT NULL THEN row_number() OVER (PARTITION BY q.doc_id, round IS NULL ORDER BY round, operation_id) END AS INTEGER) AS execution_order FROM q LEFT JOIN d USING (k)""")
def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout operations of each document in the order of their dependencies; none for cycles."""
    return planning.ordered_layout(_operations(spark, sf_dir)).select("doc_id", "operation_id", "execution_order")


_STATUS = ["Passed", "NeedsReview", "NotRun", "Failed"]


@query(f"""WITH r AS (SELECT o_orderkey AS k, {sql_pick(_STATUS, "o_orderkey % 4")} AS status, {sql_pick(_RISKS, "o_orderkey // 4 % 4")} AS risk FROM orders),
    s AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'schema_version,' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'plan_id,' ELSE '' END || CASE WHEN k % 11 = 0 THEN 'before_pages,' ELSE '' END || CASE WHEN k % 13 = 0 THEN 'output_page_count,' ELSE '' END AS stale FROM r)
    SELECT k AS o_orderkey, rtrim(stale, ',') AS stale, stale = '' AND status <> 'NotRun' AS bound, CASE WHEN status = 'Passed' AND (k % 6 = 0 OR risk IN ('High', 'Blocked')) THEN 'NeedsReview' ELSE status END AS final_status FROM s""")
def review_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual reviews against the evidence they must name."""
    k = F.col("o_orderkey")
    same = {c: F.lit("x") for pair in gates.BINDINGS for c in pair if c != "wanted_version"}
    own = same | {
        "schema_version": F.when(k % 5 == 0, "0.9").otherwise("1.0"), "plan_id": k, "apply_plan_id": F.when(k % 7 == 0, k + 1).otherwise(k), "before_pages": k % 3, "compared_before": F.when(k % 11 == 0, None).otherwise(k % 3), "source_page_count": k % 3,
        "output_page_count": F.when(k % 13 == 0, 5).otherwise(2), "after_pages": F.lit(2), "compared_after": F.lit(2),
    }
    rows = read(spark, sf_dir, "orders").select(k, pick(_STATUS, k % 4).alias("status"), pick(_RISKS, F.floor(k / 4) % 4).alias("highest_risk"), (k % 6 == 0).alias("pages_block"), *[c.alias(n) for n, c in own.items()])
    made = gates.bind_review(rows).withColumn("final_status", gates.review_status(F.col("status"), F.col("pages_block"), F.col("highest_risk")))
    return made.select("o_orderkey", F.array_join("stale", ",").alias("stale"), "bound", "final_status")


@query(f"""WITH r AS (SELECT o_orderkey, {" || ".join(f"CASE WHEN o_orderkey % {i + 2} = 0 THEN '{name},' ELSE '' END" for i, (_, name) in enumerate(gates.REASONS))} AS reasons FROM orders)
    SELECT o_orderkey, rtrim(reasons, ',') AS reasons, reasons = '' AS ready, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 10 END AS code FROM r""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps candidates from export, in fixed order, and exit codes."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k, *[(k % (i + 2) != 0).alias(c) for i, (c, _) in enumerate(gates.REASONS)])
    code = gates.exit_code(pick(["passed", "invalidInput", "needsConfirmation", "failed", "crashed"], k % 5))
    return gates.validate_output(rows).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), "ready", code.alias("code"))


@query(f"""WITH {_OPERATIONS}, s AS (SELECT DISTINCT operation_id FROM q WHERE doc_id = 1 UNION ALL SELECT 'unknown')
    SELECT s.operation_id, level FROM s LEFT JOIN (SELECT * FROM q WHERE doc_id = 0) USING (operation_id) WHERE level IS DISTINCT FROM 'Experimental'""")
def experimental_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected operations that are unknown or not experimental."""
    ops = planning.layout_operations(_operations(spark, sf_dir), True)
    asked = ops.filter("doc_id = 1").select("operation_id").distinct().union(spark.createDataFrame([("unknown",)], "operation_id string"))
    return gates.experimental_only(asked, ops.filter("doc_id = 0"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of orders as documents: their lines' numbers."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    big = lambda c: c.cast("bigint")
    return read(spark, sf_dir, "lineitem").groupBy(k.alias("doc_id"), (n - 1).cast("int").alias("section_ix")).agg(
        F.min(F.when(n % 3 != 0, big(12000 + n))).alias("width_tw"), F.min(big(15840 + n * 0)).alias("height_tw"), F.min(F.when(n % 2 == 0, "Landscape").otherwise("Portrait")).alias("orientation"), F.min(big(n * 100)).alias("top_tw"), F.min(big(n * 0 + 720)).alias("right_tw"),
        F.min(big(n * 0 + 1080)).alias("bottom_tw"), F.min(big(n * 0 + 720)).alias("left_tw"), F.min((k % 2 + 1).cast("int")).alias("columns"), F.min(big(k % 3 * 180)).alias("gap_tw"), F.first(F.lit(None).cast("string")).alias("start"),
    )


_SECTIONS = """s AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INTEGER) AS section_ix, CASE WHEN l_linenumber % 3 <> 0 THEN 12000 + l_linenumber END AS width_tw, CASE WHEN l_linenumber % 2 = 0 THEN 'Landscape' ELSE 'Portrait' END AS orientation,
    l_linenumber * 100 AS top_tw, CAST(l_orderkey % 2 + 1 AS INTEGER) AS columns, l_orderkey % 3 * 180 AS gap_tw FROM lineitem)"""


@query(f"""WITH {_SECTIONS}, v AS (SELECT doc_id, section_ix, unnest([{{'p': 'PageWidth', 'v': 'twip:' || width_tw}}, {{'p': 'PageHeight', 'v': 'twip:15840'}}, {{'p': 'PageOrientation', 'v': 'orientation:' || orientation}}, {{'p': 'MarginTop', 'v': 'twip:' || top_tw}},
        {{'p': 'MarginRight', 'v': 'twip:720'}}, {{'p': 'MarginBottom', 'v': 'twip:1080'}}, {{'p': 'MarginLeft', 'v': 'twip:720'}}, {{'p': 'ColumnCount', 'v': 'int:' || columns}}, {{'p': 'ColumnSpacing', 'v': 'twip:' || gap_tw}}]) AS x FROM s)
    SELECT doc_id, section_ix, x.p AS property, x.v AS current FROM v""")
def page_value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine value keys a section."""
    return C.page_values(_sections(spark, sf_dir))


_PAGE_RULES = ", ".join(str((p, v)) for p, v in rules.PAGE.items())
_BODIES = ", ".join(f"'{k}'" for k in C.BODY_KINDS)


@query(f"""WITH {Q.OBSERVED_SQL}, page_rules(property, expected) AS (VALUES {_PAGE_RULES}),
    secs AS (SELECT doc_id, unnest(range(0, 1 + CAST(doc_id % 2 AS BIGINT))) AS section_ix FROM documents),
    vals AS (SELECT doc_id, section_ix, unnest([{{'p': 'PageWidth', 'v': 'twip:' || (12240 - section_ix)}}, {{'p': 'PageHeight', 'v': NULL}}, {{'p': 'PageOrientation', 'v': 'orientation:Portrait'}}, {{'p': 'MarginTop', 'v': 'twip:1080'}}, {{'p': 'MarginRight', 'v': 'twip:720'}},
        {{'p': 'MarginBottom', 'v': 'twip:1080'}}, {{'p': 'MarginLeft', 'v': 'twip:' || doc_id % 3 * 360}}, {{'p': 'ColumnCount', 'v': 'int:' || (section_ix + 1)}}, {{'p': 'ColumnSpacing', 'v': 'twip:360'}}]) AS x FROM secs),
    sure AS (SELECT DISTINCT doc_id FROM elements WHERE status = 'Confirmed' AND kind IN ({_BODIES})),
    paged AS (SELECT v.doc_id, x.v IS NOT DISTINCT FROM r.expected AS passed FROM vals v JOIN page_rules r ON r.property = x.p LEFT JOIN sure ON sure.doc_id = v.doc_id WHERE NOT starts_with(x.p, 'Column') OR sure.doc_id IS NULL OR section_ix = 0),
    caps AS (SELECT e.doc_id, e.kind, {Q.trim("m.text")} AS t, row_number() OVER (PARTITION BY e.doc_id, e.kind ORDER BY e.pos) AS place FROM elements e JOIN manuscript m ON m.doc_id = e.doc_id AND m.path = e.path WHERE e.status = 'Confirmed' AND e.kind IN ('FigureCaption', 'TableCaption')),
    tok AS (SELECT *, CASE WHEN kind = 'FigureCaption' THEN regexp_extract(t, '([0-9]+)', 1) ELSE regexp_extract(t, '^[^ ]* \\s*([\\p{{L}}\\p{{Nd}}]*)', 1) END AS token FROM caps),
    num AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(token, '^([0-9]+)', 1), '') AS INTEGER), CASE upper(token) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 WHEN 'L' THEN 50 WHEN 'V' THEN 5 WHEN 'X' THEN 10 END) AS number FROM tok),
    every AS (SELECT doc_id, passed, CASE WHEN true THEN 'Warning' END AS severity FROM observed UNION ALL SELECT doc_id, passed, 'Error' FROM paged UNION ALL SELECT doc_id, coalesce(number = place, false), 'Warning' FROM num)
    SELECT doc_id, count(*) AS observations, count_if(passed)::BIGINT AS passed, count_if(NOT passed)::BIGINT AS issues, count_if(NOT passed AND severity = 'Error')::BIGINT AS errors, count_if(NOT passed AND severity = 'Warning')::BIGINT AS warnings,
        CAST(round(count_if(passed) * 100::DECIMAL(20,0) / count(*), 0) AS INTEGER) AS score, CASE WHEN count_if(NOT passed) > 0 THEN 'IssuesFound' ELSE 'Passed' END AS status, 179 AS enabled_rules FROM every GROUP BY doc_id""")
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 179 rules, page and caption rules too, against manuscripts with sections: the checker's own summary."""
    docs, none = _full_check(spark, sf_dir)
    observed, elements, package, skipped = none
    return C.summary(docs, observed, skipped, elements, package).select("doc_id", "observations", "passed", "issues", "errors", "warnings", "score", "status", F.col("enabled_rules").cast("int").alias("enabled_rules"))


def _full_check(spark: SparkSession, sf_dir: str):
    rows, elements = _elements(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id")
    section = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int")))
    big = lambda c: c.cast("bigint")
    sections = docs.select("doc_id", section.alias("section_ix")).select(
        "doc_id", "section_ix", big(12240 - F.col("section_ix")).alias("width_tw"), F.lit(None).cast("bigint").alias("height_tw"), F.lit(None).cast("string").alias("orientation"), F.lit(1080).cast("bigint").alias("top_tw"), F.lit(720).cast("bigint").alias("right_tw"),
        F.lit(1080).cast("bigint").alias("bottom_tw"), big(F.col("doc_id") % 3 * 360).alias("left_tw"), (F.col("section_ix") + 1).alias("columns"), F.lit(360).cast("bigint").alias("gap_tw"),
    )
    para = F.struct("align", F.lit(None).cast("string").alias("spacing_kind"), *[F.lit(None).cast("bigint").alias(c) for c in ("spacing_value", "before_tw", "after_tw", "first_line_tw")])
    fonts = F.struct(F.lit("TIMES NEW ROMAN").alias("font_ascii"), F.lit("Arial").alias("font_hansi"), F.lit(" ").alias("font_ea"), F.lit(None).cast("string").alias("font_cs"), "size_tw", "bold", "italic")
    paragraphs = rows.withColumn("effective", para).withColumn("has_own", F.lit(False))
    runs = rows.select("doc_id", F.col("path").alias("para_path"), F.col("loc").withField("run_ix", F.lit(0)).alias("loc"), "text", fonts.alias("effective"), F.lit(False).alias("has_own"))
    paragraphs = C.direct_formatting(paragraphs, runs)
    package = rules.builtin_rules(spark)
    observed = staged(C.observations(sections, paragraphs, runs, elements, package), "observed")
    skipped = staged(C.skips(docs, sections, paragraphs, runs, elements, package), "skipped")
    return docs, (observed, elements, package, skipped)


_TEXT_TARGETS = ", ".join(f"('{t}')" for t in rules.TEXT)


@query(f"""WITH {Q.ELEMENTS_SQL}, targets(target) AS (VALUES {_TEXT_TARGETS}), k AS (SELECT doc_id, kind AS target, bool_or(status = 'Confirmed') AS sure, bool_or(status = 'NeedsConfirmation') AS open FROM elements GROUP BY ALL),
    per(target, n) AS (VALUES {", ".join(str((t, len(rules._text_values(t)) + (2 if t == "Body" else 1 if t.endswith("Caption") else 0))) for t in rules.TEXT)}),
    s AS (SELECT d.doc_id, t.target, n, coalesce(sure, false) AS sure, coalesce(open, false) AS open FROM documents d CROSS JOIN targets t JOIN per ON per.target = t.target LEFT JOIN k ON k.doc_id = d.doc_id AND k.target = t.target)
    SELECT doc_id, reason, CAST(sum(n) AS BIGINT) AS rules FROM (SELECT doc_id, n, 'classification_pending' AS reason FROM s WHERE open UNION ALL SELECT doc_id, n, 'no_matching_element' FROM s WHERE NOT sure AND NOT open) GROUP BY ALL""")
def check_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that found nothing to look at, by reason."""
    _, (_, _, _, skipped) = _full_check(spark, sf_dir)
    return skipped.groupBy("doc_id", "reason").agg(F.count("*").alias("rules"))


_EDITED = {"PageWidth": ("doc_id % 2 = 0", "twip:12240"), "PageOrientation": ("section_ix % 3 = 0", "orientation:Landscape"), "MarginTop": ("doc_id % 5 = 0 AND section_ix = 1", "twip:7")}


@query(f"""WITH {_SECTIONS} SELECT doc_id, section_ix, CAST(CASE WHEN doc_id % 2 = 0 THEN 12240 ELSE width_tw END AS BIGINT) AS width_tw, CASE WHEN section_ix % 3 = 0 THEN 'Landscape' ELSE orientation END AS orientation,
    CAST(CASE WHEN doc_id % 5 = 0 AND section_ix = 1 THEN 7 ELSE top_tw END AS BIGINT) AS top_tw FROM s""")
def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page settings under edits."""
    rows = staged(_sections(spark, sf_dir), "sections")
    edits = None
    for name, (condition, value) in _EDITED.items():
        part = rows.filter(condition).select("doc_id", location(section_ix=F.col("section_ix")).alias("loc"), F.lit("Page").alias("target"), F.lit(name).alias("property"), F.lit(value).alias("expected"))
        edits = part if edits is None else edits.union(part)
    return repair.mutate_pages(rows, edits).select("doc_id", "section_ix", "width_tw", "orientation", "top_tw")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.floor(K() / 64).alias("doc_id"), K().alias("k"), canonical_path(location(section_ix=F.lit(0), para_ix=K() % 64)).alias("path"), F.col("p_size").cast("bigint").alias("size"))


@query("""SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 3 = 0 THEN 200 ELSE p_size END AS BIGINT) AS size_tw, CASE WHEN p_partkey % 4 = 0 THEN true END AS bold, CASE WHEN p_partkey % 5 = 0 THEN 'Times' ELSE 'Arial' END AS font,
    CASE WHEN p_partkey % 3 = 0 THEN 'Center' ELSE 'Left' END AS align, CASE WHEN p_partkey % 2 = 0 THEN 289 END AS first_line_tw, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 360 END AS hanging_tw,
    CASE WHEN p_partkey % 7 = 0 THEN 'Auto' WHEN p_partkey % 7 = 1 THEN 'Exact' END AS spacing_kind, CASE WHEN p_partkey % 7 = 0 THEN 240 WHEN p_partkey % 7 = 1 THEN 300 END AS spacing_value, CASE WHEN p_partkey % 11 = 0 THEN 'BodyText' ELSE 'x' END AS style_id FROM part""")
def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and paragraph formatting under edits; a first-line indent clears a hanging one."""
    rows = staged(_paths(spark, sf_dir), "places")
    wanted = [
        (3, 0, "FontSize", "twip:200"), (4, 0, "Bold", "bool:True"), (5, 0, "FontAscii", "text:Times"), (3, 0, "ParagraphAlignment", "alignment:Center"), (2, 0, "FirstLineIndent", "twip:289"), (7, 0, "LineSpacing", "spacing:Auto::240"), (7, 1, "LineSpacing", "spacing:Exact:300:"),
        (11, 0, "ParagraphStyleId", "text:BodyText"),
    ]
    edits = F.array(*[F.when(F.col("k") % by == rest, F.struct(F.lit(p).alias("property"), F.lit(v).alias("expected"))) for by, rest, p, v in wanted])
    edits = rows.select("doc_id", "path", F.explode(F.filter(edits, lambda e: e.isNotNull())).alias("e")).select("doc_id", "path", "e.*")
    chars = F.struct(F.lit("Arial").alias("font_ascii"), *[F.lit(None).cast("string").alias(f) for f in ("font_hansi", "font_ea", "font_cs")], F.col("size").alias("size_tw"), *[F.lit(None).cast("boolean").alias(f) for f in ("bold", "italic")])
    para = F.struct(F.lit("Left").alias("align"), F.lit(None).cast("string").alias("spacing_kind"), *[F.lit(None).cast("bigint").alias(f) for f in ("spacing_value", "before_tw", "after_tw", "first_line_tw")], F.lit(360).cast("bigint").alias("hanging_tw"))
    runs = repair.mutate_runs(rows.withColumn("effective", chars), edits).select("doc_id", "path", "k", "effective.size_tw", "effective.bold", F.col("effective.font_ascii").alias("font"))
    text = repair.mutate_paragraphs(rows.withColumn("effective", para).withColumn("style_id", F.lit("x")), edits).select("doc_id", "path", "effective.align", "effective.first_line_tw", "effective.hanging_tw", "effective.spacing_kind", "effective.spacing_value", "style_id")
    return runs.join(text, ["doc_id", "path"]).drop("doc_id", "path")


_ALL_RULES = ", ".join(str((t, p, v)) for t in rules.TEXT for p, v in [*rules._text_values(t).items(), *([("FirstLineIndent", "twip:289"), ("DirectFormattingConsistency", "bool:True")] if t == "Body" else [("CaptionNumberSequence", "bool:True")] if t.endswith("Caption") else [])])


@query(f"""WITH r(target, property, expected) AS (VALUES {_ALL_RULES}), w AS (SELECT DISTINCT substr(expected, 6) AS style_id, target FROM r WHERE property = 'ParagraphStyleId'), n AS (SELECT style_id, count(*) AS k FROM w GROUP BY 1),
    a AS (SELECT w.style_id, r.property, min(r.expected) AS value FROM w JOIN r USING (target) JOIN n USING (style_id) WHERE r.property <> 'ParagraphStyleId' GROUP BY w.style_id, r.property, n.k HAVING count(DISTINCT r.expected) = 1 AND count(DISTINCT w.target) = n.k),
    docs AS (SELECT DISTINCT s_suppkey AS doc_id, s_suppkey % 2 = 0 AS normal FROM supplier)
    SELECT doc_id, style_id, CASE WHEN normal AND style_id <> 'Normal' THEN 'Normal' END AS based_on, property, value FROM docs CROSS JOIN a WHERE NOT (doc_id % 3 = 0 AND style_id = 'BodyText') AND NOT (doc_id % 5 = 0 AND style_id = 'Caption')""")
def missing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles that rules ask for and documents lack, with the values that all their targets agree on."""
    k = F.col("s_suppkey")
    own = F.array(F.lit("Other"), F.when(k % 2 == 0, "Normal"), F.when(k % 3 == 0, "BodyText"), F.when(k % 5 == 0, "Caption"))
    sheet = read(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.explode(F.filter(own, lambda x: x.isNotNull())).alias("style_id"))
    return repair.materialized_styles(rules.builtin_rules(spark), sheet)


@query("""WITH i AS (SELECT p_partkey AS k, p_partkey // 64 AS doc_id, 'main/section[0]/paragraph[' || p_partkey % 64 || ']' AS path, 'i' || p_partkey AS issue_id, p_partkey % 4 <> 0 AS allowed, p_partkey % 6 <> 0 AS there FROM part),
    s AS (SELECT *, CASE WHEN NOT allowed THEN 'Skipped' WHEN there THEN 'Applied' ELSE 'Failed' END AS status FROM i)
    SELECT issue_id, status, 'change-' || left(sha256(issue_id || '|Bold|' || status), 20) AS change_id, 'repair-v1-' || left(sha256(issue_id || '|p|3|True|a,b'), 20) AS operation_id FROM s""")
def repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of authorized changes, with stable ids."""
    rows = _paths(spark, sf_dir)
    asked = rows.select("doc_id", "path", F.format_string("i%d", "k").alias("issue_id"), F.lit("Bold").alias("property"), (F.col("k") % 4 != 0).alias("allowed"))
    log = repair.change_log(asked, rows.filter("k % 6 <> 0"))
    return log.select("issue_id", "status", "change_id", repair.operation_id(F.col("issue_id"), F.lit("p"), F.lit(3), True, F.array(F.lit("a"), F.lit("b"))).alias("operation_id"))


@query(f"""WITH {_SECTIONS}, last AS (SELECT doc_id, max(section_ix) AS last, count(*) AS n0 FROM s GROUP BY 1),
    b AS (SELECT s.doc_id, section_ix + CASE WHEN s.doc_id % 4 = 0 AND section_ix = last THEN 1 ELSE 0 END AS section_ix, columns, gap_tw, CASE WHEN s.doc_id % 4 = 0 AND section_ix = last THEN 'continuous' END AS start FROM s JOIN last USING (doc_id)
        UNION ALL SELECT doc_id, last, 1, 0, NULL FROM last WHERE doc_id % 4 = 0),
    c AS (SELECT doc_id, section_ix, CASE WHEN doc_id % 3 = 0 AND section_ix = 0 THEN 3 ELSE columns END AS columns, CASE WHEN doc_id % 3 = 0 AND section_ix = 0 THEN 360 ELSE gap_tw END AS gap_tw, start FROM b),
    ok AS (SELECT doc_id, max(n0) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END = count(*) AND (doc_id % 4 <> 0 OR arg_min(columns, section_ix) = 1) AND (doc_id % 3 <> 0 OR min(section_ix) = 0) AS matches FROM c JOIN last USING (doc_id) GROUP BY doc_id)
    SELECT c.doc_id, CAST(section_ix AS INTEGER) AS section_ix, CAST(columns AS INTEGER) AS columns, CAST(gap_tw AS BIGINT) AS gap_tw, start, matches FROM c JOIN ok USING (doc_id)""")
def layout_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section breaks and columns, and whether the result is what was asked for."""
    before = staged(_sections(spark, sf_dir).select("doc_id", "section_ix", "columns", "gap_tw", "start"), "before")
    docs = before.select("doc_id").distinct()
    breaks = docs.filter("doc_id % 4 = 0").withColumn("start", F.lit("continuous"))
    wanted = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("section_ix"), F.lit(3).alias("columns"), F.lit(360).cast("bigint").alias("gap_tw"))
    after = staged(layout.set_columns(layout.insert_break(before, breaks), wanted), "after")
    return after.join(layout.layout_matches(before, after, breaks, wanted), "doc_id").select("doc_id", "section_ix", "columns", "gap_tw", "start", "matches")


_OBJECTS = ["table", "merged_table", "inline", "anchor", "equation", "field", "other"]
_FOUND = ["WideTable", "MergedTable", "InlineDrawing", "FloatingDrawing", "Equation", "Field", None]


@query(f"""WITH o AS (SELECT p_partkey AS k, p_partkey // 64 AS doc_id, p_partkey % 7 AS t, p_size * 100 AS w, 'main/section[0]/paragraph[' || p_partkey || ']' AS path FROM part),
    f AS (SELECT *, CASE WHEN t = 0 AND w <= 2500 OR t = 2 AND w <= 2500 THEN NULL ELSE {sql_pick(_FOUND, "t")} END AS kind FROM o)
    SELECT doc_id, path, kind, CASE WHEN kind IN ('MergedTable', 'FloatingDrawing') THEN 'Experimental' ELSE 'Review' END AS level, 'layout-risk-' || left(sha256(kind || '|' || path), 20) AS finding_id FROM f WHERE kind IS NOT NULL""")
def layout_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a narrower column endangers."""
    wide = F.col("p_size").cast("bigint") * 100
    rows = read(spark, sf_dir, "part").select(F.floor(K() / 64).alias("doc_id"), location(section_ix=F.lit(0), para_ix=K()).alias("loc"), pick(_OBJECTS, K() % 7).alias("object"), wide.alias("width_tw"), (wide * 635).alias("width_emu"))
    return layout.risks(rows, 2500).select("doc_id", canonical_path(F.col("loc")).alias("path"), "kind", "level", "finding_id")


@query(f"""WITH {_SECTIONS}, {Q.ELEMENTS_SQL}, e AS (SELECT doc_id, max(CASE WHEN kind IN ('Title', 'Author', 'Affiliation', 'Abstract', 'Keywords') THEN pos END) AS fe FROM elements GROUP BY 1),
    b AS (SELECT doc_id, fe, (SELECT min(pos) FROM elements x WHERE x.doc_id = e.doc_id AND x.kind IN ('Heading1', 'Body') AND (fe IS NULL OR x.pos > fe)) AS bs FROM e),
    p AS (SELECT doc_id, count(*) AS sections, string_agg(columns::VARCHAR, ',' ORDER BY section_ix) AS columns, max(columns) AS most FROM s GROUP BY 1)
    SELECT p.doc_id, p.sections, p.columns, concat_ws(',', CASE WHEN sections <> 1 THEN 'several_sections' END, CASE WHEN most <> 1 THEN 'not_single_column' END, CASE WHEN fe IS NULL OR bs IS NULL THEN 'no_boundary' END) AS blockers,
        sections = 1 AND most = 1 AND fe IS NOT NULL AND bs IS NOT NULL AS convertible, 2 AS target_columns FROM p LEFT JOIN b ON b.doc_id = p.doc_id""")
def layout_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against more columns."""
    _, elements = _elements(spark, sf_dir)
    found = layout.analyse(_sections(spark, sf_dir), elements, rules.builtin_rules(spark))
    return found.select("doc_id", "sections", F.array_join(F.transform("columns", lambda c: c.cast("string")), ",").alias("columns"), F.array_join("blockers", ",").alias("blockers"), "convertible", "target_columns")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, lag(o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS behind FROM orders),
    nxt AS (SELECT o_custkey, min(o_orderkey) AS next_key FROM x WHERE behind GROUP BY 1), t AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS first3 FROM x WHERE position < 3 GROUP BY 1),
    d AS (SELECT o_custkey, count(*) AS repeated FROM (SELECT o_custkey, o_orderpriority FROM orders GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
    SELECT o_custkey, max(position) AS last_position, any_value(next_key) AS next_key, any_value(first3) AS first3, coalesce(any_value(repeated), 0) AS repeated FROM x LEFT JOIN nxt USING (o_custkey) LEFT JOIN t USING (o_custkey) LEFT JOIN d USING (o_custkey) GROUP BY 1""")
def ordered_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering, the row behind a marked one, the first three, and repeated keys."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    key = ["o_custkey"]
    places = R.numbered(rows, key, "o_orderkey").groupBy(*key).agg(F.max("position").cast("bigint").alias("last_position"))
    behind = R.next_after(rows, key, "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", F.col("o_orderkey").alias("next_key"))
    first = R.top(rows, key, [F.col("o_orderkey")], 3).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("first3"))
    twice = R.duplicates(rows, "o_custkey", "o_orderpriority").groupBy(*key).agg(F.count("*").alias("repeated"))
    return places.join(behind, key, "left").join(first, key, "left").join(twice, key, "left").na.fill(0, ["repeated"])


@query("""WITH a AS (SELECT l_partkey % 50 AS k FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_partkey % 60 AS k FROM lineitem WHERE l_orderkey % 2 = 1)
    SELECT (SELECT count(*) FROM (SELECT DISTINCT k FROM b EXCEPT SELECT k FROM a)) AS missing, (SELECT count(*) = 0 FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM a)) AS contained, (SELECT count(*) = 0 FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) AS other,
        (SELECT count(DISTINCT k) FROM a) AS distinct_keys""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets, differences and multisets."""
    rows = read(spark, sf_dir, "lineitem")
    a, b = rows.filter("l_orderkey % 2 = 0").select((F.col("l_partkey") % 50).alias("k")), rows.filter("l_orderkey % 2 = 1").select((F.col("l_partkey") % 60).alias("k"))
    return spark.createDataFrame([(R.not_subset(b, a, "k").count(), R.multiset_contained(a, a), R.multiset_contained(b, a), a.distinct().count())], "missing long, contained boolean, other boolean, distinct_keys long")


@query(f"WITH {Q.ELEMENTS_SQL} SELECT doc_id, path, kind, status FROM elements WHERE pos % 3 = 0")
def element_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements at given places."""
    _, elements = _elements(spark, sf_dir)
    return locations.find(elements, elements.filter(F.col("loc.para_ix") % 3 == 0).select("doc_id", "path")).select("doc_id", "path", "kind", "status")


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of parts, with paragraph and table values, numbers and links."""
    rows = _part_styles(spark, sf_dir)
    place, size = F.col("ord"), F.col("chr.size_tw")
    para = F.struct(*[(F.when(place % 3 == 0, place * 10).cast("bigint") if f == "before_tw" else F.lit(None)).cast(dict(x.split(":") for x in styles.struct_type(styles.PARA)[7:-1].split(","))[f]).alias(f) for f in styles.PARA])
    tbl = F.struct(F.when(place % 5 == 0, place).cast("bigint").alias("width_tw"), F.lit(None).cast("string").alias("align"), F.lit(None).cast("boolean").alias("autofit"))
    return rows.withColumn("para", para).withColumn("tbl", tbl).withColumn("num_id", F.when(place % 8 == 1, place.cast("string"))).withColumn("level", F.lit("0")).withColumn("linked", F.when(place == 9, F.lit("nowhere"))).withColumn("_s", size).drop("_s")


_CONTRIBUTED = f"""{_SHEETS}, ring AS (SELECT DISTINCT doc_id, id FROM up WHERE depth > 0 AND id = anc),
    f AS (SELECT u.doc_id, u.id, u.anc, min(u.depth) AS depth FROM up u WHERE NOT EXISTS (
        SELECT 1 FROM up v JOIN ring r ON r.doc_id = v.doc_id AND r.id = v.anc WHERE v.doc_id = u.doc_id AND v.id = u.id AND v.depth < u.depth) GROUP BY u.doc_id, u.id, u.anc),
    own AS (SELECT doc_id, id, CASE WHEN id % 2 = 0 THEN CAST(p_size AS BIGINT) END AS size_tw, CASE WHEN id % 3 = 0 THEN id * 10 END AS before_tw, CASE WHEN id % 5 = 0 THEN id END AS width_tw FROM s),
    g AS (SELECT f.doc_id, f.id, arg_min(o.size_tw, f.depth) FILTER (o.size_tw IS NOT NULL) AS size_tw, arg_min(o.before_tw, f.depth) FILTER (o.before_tw IS NOT NULL) AS before_tw, arg_min(o.width_tw, f.depth) FILTER (o.width_tw IS NOT NULL) AS width_tw
        FROM f LEFT JOIN own o ON o.doc_id = f.doc_id AND o.id = f.anc GROUP BY f.doc_id, f.id)"""


@query(f"""WITH {_CONTRIBUTED} SELECT s.doc_id, s.id AS place, CAST(coalesce(CASE WHEN s.id % 7 = 0 THEN 11 END, r.size_tw, CASE WHEN s.id % 11 = 0 THEN 22 END, p.size_tw, 100) AS BIGINT) AS size_tw, CAST(coalesce(CASE WHEN s.id % 4 = 0 THEN 33 END, p.before_tw, 7) AS BIGINT) AS before_tw,
    CAST(coalesce(CASE WHEN s.id % 6 = 0 THEN 44 END, t.width_tw) AS BIGINT) AS width_tw
    FROM s LEFT JOIN g p ON p.doc_id = s.doc_id AND p.id = CASE WHEN s.id % 5 <> 0 THEN s.id END LEFT JOIN g r ON r.doc_id = s.doc_id AND r.id = (s.id + 1) % 64 LEFT JOIN g t ON t.doc_id = s.doc_id AND t.id = s.id""")
def effective_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, paragraphs and tables through all their layers: defaults, styles, marks, direct formatting."""
    sheets = staged(_sheets(spark, sf_dir), "sheets")
    base = sheets.select("doc_id").distinct()
    place = F.col("ord")

    def bag(fields: list[str], of: str, value: Column) -> Column:
        kinds = dict(x.split(":") for x in styles.struct_type(fields)[7:-1].split(","))
        return F.struct(*[(value if f == of else F.lit(None)).cast(kinds[f]).alias(f) for f in fields])

    defaults = base.select("doc_id", bag(styles.PARA, "before_tw", F.lit(7)).alias("para"), bag(styles.CHR, "size_tw", F.lit(100)).alias("chr"))
    used = F.when(place % 5 != 0, F.col("style_id")).alias("style_id")
    none = F.lit(None).cast("string").alias("table_style_id")
    runs = sheets.select("doc_id", place.alias("place"), used, none, ((place + 1) % 64).cast("string").alias("run_style_id"), bag(styles.CHR, "size_tw", F.when(place % 11 == 0, 22)).alias("mark"), bag(styles.CHR, "size_tw", F.when(place % 7 == 0, 11)).alias("direct"))
    paras = sheets.select("doc_id", place.alias("place"), used, none, bag(styles.PARA, "before_tw", F.when(place % 4 == 0, 33)).alias("direct"))
    tables = sheets.select("doc_id", place.alias("place"), "style_id", bag(styles.TBL, "width_tw", F.when(place % 6 == 0, 44)).alias("direct"))
    given = staged(styles.contributions(sheets), "contributions")
    a = styles.effective_runs(runs, sheets, defaults, given=given).select("doc_id", "place", F.col("effective.size_tw").alias("size_tw"))
    b = styles.effective_paragraphs(paras, sheets, defaults, given=given).select("doc_id", "place", F.col("effective.before_tw").alias("before_tw"))
    c = styles.effective_tables(tables, sheets, given=given).select("doc_id", "place", F.col("effective.width_tw").alias("width_tw"))
    return a.join(R.shuffled(b), ["doc_id", "place"]).join(R.shuffled(c), ["doc_id", "place"])


@query(f"""WITH {_SHEETS}, top AS (SELECT doc_id, max(id) AS most FROM s GROUP BY 1), ring AS (SELECT DISTINCT doc_id FROM up WHERE depth > 0 AND id = anc),
    bad AS (SELECT DISTINCT s.doc_id FROM s LEFT JOIN s b ON b.doc_id = s.doc_id AND b.id = s.base WHERE s.base IS NOT NULL AND b.id IS NULL)
    SELECT doc_id, 'missing_linked_style' AS code FROM s WHERE id = 9 UNION ALL SELECT doc_id, 'style_inheritance_cycle' FROM ring UNION ALL SELECT doc_id, 'missing_base_style' FROM bad UNION ALL SELECT doc_id, 'undefined:' || (most + 1) FROM top""")
def style_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references of style sheets, and of what uses them."""
    sheets = staged(_sheets(spark, sf_dir), "sheets")
    used = sheets.groupBy("doc_id").agg((F.max("ord") + 1).cast("string").alias("style_id"))
    missing = styles.undefined_references(used.union(sheets.select("doc_id", "style_id")), sheets)
    return styles.style_diagnostics(sheets).union(missing.select("doc_id", F.concat(F.lit("undefined:"), "style_id")))


@query(f"""WITH {_SHEETS}, f AS (SELECT doc_id, id, anc, min(depth) AS depth FROM up GROUP BY ALL)
    SELECT doc_id, CAST(id AS VARCHAR) AS style_id, CAST(arg_min(anc, depth) AS VARCHAR) AS num_id FROM f WHERE anc % 8 = 1 GROUP BY doc_id, id""")
def style_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the nearest style upwards that has one."""
    return styles.numbering(_sheets(spark, sf_dir)).select("doc_id", "style_id", "num_id")


@query("""WITH r AS (SELECT s_suppkey AS request, s_nationkey AS v, s_suppkey % 4 AS y, s_suppkey % 9 = 0 AS bare FROM supplier), t AS (SELECT c_custkey AS id, c_nationkey AS v, c_custkey % 16 // 4 AS y, c_custkey % 3 AS g, c_custkey % 5 = 0 AS manual FROM customer WHERE c_custkey % 8 = 0),
    m AS (SELECT request, any_value(bare) AS bare, count(id) AS n, min(printf('t%06d', id)) AS template_id, min(CASE g WHEN 0 THEN 'disabled' WHEN 1 THEN 'superseded' ELSE 'validated' END) AS g, min(CASE WHEN manual THEN 'explicit-only' ELSE 'exact-identity' END) AS mode
        FROM r LEFT JOIN t ON r.v = t.v AND r.y = t.y AND NOT bare GROUP BY request)
    SELECT request, CASE WHEN bare THEN 'invalid_identity' WHEN n = 0 THEN 'needs_exact_template' WHEN n > 1 THEN 'error' WHEN g <> 'validated' THEN 'unavailable' WHEN mode <> 'exact-identity' THEN 'needs_explicit_selection' ELSE 'resolved' END AS status,
        CASE WHEN n = 1 THEN template_id END AS template_id FROM m""")
def template_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for templates by full identity."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    fixed = {"publisher": F.lit("Press"), "track": F.lit("main"), "stage": F.lit("review"), "template_version": F.lit("1")}
    asked = read(spark, sf_dir, "supplier").select(s.alias("request"), F.lit("docx").alias("format"), F.format_string(" Venue  %d", "s_nationkey").alias("venue"), F.when(s % 9 != 0, (s % 4).cast("string")).alias("year"), *[F.upper(v).alias(k) for k, v in fixed.items()])
    known = read(spark, sf_dir, "customer").filter(c % 8 == 0).select(
        F.format_string("t%06d", c).alias("template_id"), F.lit("docx").alias("format"), F.format_string("venue %d", "c_nationkey").alias("venue"), F.floor(c % 16 / 4).cast("string").alias("year"), *[v.alias(k) for k, v in fixed.items()],
        pick(["disabled", "superseded", "validated"], c % 3).alias("status"), F.when(c % 5 == 0, "explicit-only").otherwise("exact-identity").alias("selection_mode"),
    )
    return venues.resolve_templates(asked, known).select("request", "status", "template_id")


@query("""WITH s AS (SELECT p_partkey // 64 AS doc_id, ['Title', 'Body', 'TableText'][p_partkey % 64 + 1] AS target, p_size AS size, p_partkey FROM part WHERE p_partkey % 64 < 3),
    v AS (SELECT doc_id, target, unnest([{'p': 'FontSize', 'v': 'twip:' || size}, {'p': 'FontAscii', 'v': CASE WHEN p_partkey % 2 = 0 THEN 'text:Arial' END}, {'p': 'Bold', 'v': CASE WHEN size > 25 THEN 'bool:True' ELSE 'bool:False' END},
        {'p': 'ParagraphAlignment', 'v': 'alignment:Left'}, {'p': 'SpaceBefore', 'v': 'twip:' || size * 2}, {'p': 'LineSpacing', 'v': CASE WHEN p_partkey % 3 = 0 THEN 'spacing:Auto::240' END}]) AS x FROM s)
    SELECT doc_id, 'template-v1.' || CASE target WHEN 'TableText' THEN 'table-text' ELSE lower(target) END || '.' || CASE x.p WHEN 'FontSize' THEN 'font-size' WHEN 'FontAscii' THEN 'font-ascii' WHEN 'Bold' THEN 'bold' WHEN 'ParagraphAlignment' THEN 'paragraph-alignment'
        WHEN 'SpaceBefore' THEN 'space-before' ELSE 'line-spacing' END AS rule_id, x.v AS expected FROM v WHERE x.v IS NOT NULL AND (target <> 'TableText' OR x.p IN ('FontSize', 'FontAscii'))""")
def template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the samples of templates: a rule for each value that is known."""
    size = F.col("p_size").cast("bigint")
    text = lambda c: c.cast("string")
    runs = read(spark, sf_dir, "part").filter(K() % 64 < 3)
    fonts = F.struct(F.when(K() % 2 == 0, text(F.lit("Arial"))).alias("font_ascii"), *[F.lit(None).cast("string").alias(f) for f in ("font_hansi", "font_ea", "font_cs")], size.alias("size_tw"), (size > 25).alias("bold"), F.lit(None).cast("boolean").alias("italic"))
    para = F.struct(F.lit("Left").alias("align"), F.when(K() % 3 == 0, "Auto").alias("spacing_kind"), F.when(K() % 3 == 0, 240).cast("bigint").alias("spacing_value"), (size * 2).alias("before_tw"), *[F.lit(None).cast("bigint").alias(f) for f in ("after_tw", "first_line_tw")])
    rows = runs.select(F.floor(K() / 64).alias("doc_id"), pick(["Title", "Body", "TableText"], K() % 64).alias("target"), F.format_string("p%d", K() % 64).alias("path"), F.lit(None).cast("string").alias("style_id"), fonts.alias("effective"), para.alias("para"), F.lit(0.9).cast("decimal(3,2)").alias("confidence"), F.lit(False).alias("needs_confirmation"))
    none = rows.select("doc_id", "style_id", F.col("effective").alias("chr")).limit(0)
    samples = rules.sample_formatting(rows.drop("effective"), rows.select("doc_id", F.col("path").alias("para_path"), F.lit("x").alias("text"), "effective"), none)
    return rules.emitted_rules(samples).select("doc_id", "rule_id", "expected")


@query("""WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey AS k FROM nation), t(target, slug) AS (VALUES ('Title', 'title'), ('Author', 'author'), ('Affiliation', 'affiliation'), ('Abstract', 'abstract'), ('Keywords', 'keywords'), ('Heading1', 'heading-1'), ('Heading2', 'heading-2'), ('Heading3', 'heading-3'),
        ('Body', 'body'), ('FigureCaption', 'figure-caption'), ('TableCaption', 'table-caption'), ('TableText', 'table-text'), ('ReferencesHeading', 'references-heading'), ('ReferenceEntry', 'reference-entry')),
    w AS (SELECT n_regionkey AS doc_id, count(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END) AS k FROM nation GROUP BY 1)
    SELECT doc_id, 'template.' || slug || '.missing' AS code FROM (SELECT DISTINCT doc_id FROM c) CROSS JOIN t WHERE NOT (target = 'Body' AND doc_id % 2 = 0) UNION ALL SELECT doc_id, 'template.page.page-width' || CASE WHEN k = 0 THEN '.missing' ELSE '.ambiguous' END FROM w WHERE k <> 1
    UNION ALL SELECT doc_id, 'template-v1-' || left(sha256('r' || doc_id || '|docx|' || count(*) || '|' || string_agg(k::VARCHAR, ',' ORDER BY k)), 16) FROM c GROUP BY doc_id""")
def template_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a template lacks or leaves open, and its package id."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = read(spark, sf_dir, "nation").select(r.cast("bigint").alias("doc_id"), n.alias("k"))
    body = rows.filter("doc_id % 2 = 0").select("doc_id", F.lit("Body").alias("target")).distinct()
    notices = rules.page_rules(rows.select("doc_id", F.col("k").alias("section_ix"), F.lit("PageWidth").alias("property"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("twip:"), F.col("k").cast("string"))).alias("value")))[1]
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("k")), lambda x: x.cast("string")).alias("ids"))
    ids = ids.select("doc_id", rules.template_package_id(F.format_string("r%d", "doc_id"), F.lit("docx"), F.col("n"), F.col("ids")).alias("code"))
    return rules.missing_targets(body, rows).union(notices).union(ids)


@query("""WITH r AS (SELECT s_suppkey AS doc_id, 'i' || s_suppkey AS issue_id, 'Error' AS severity, CASE WHEN s_suppkey % 2 = 0 THEN 'twip:' || s_suppkey END AS current, 0.5 AS confidence FROM supplier)
    SELECT doc_id, '{"docId":' || doc_id || ',"issueId":"' || issue_id || '","severity":"Error"' || coalesce(',"current":"' || current || '"', '') || ',"autoFixable":true}' AS bare, '{"docId":' || doc_id || ',"issueId":"' || issue_id || '","severity":"Error","current":' || coalesce('"' || current || '"', 'null')
        || ',"autoFixable":true}' AS whole FROM r""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, with and without null fields, never with texts."""
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(s.cast("bigint").alias("doc_id"), F.format_string("i%d", s).alias("issue_id"), F.lit("Error").alias("severity"), F.when(s % 2 == 0, F.format_string("twip:%d", s)).alias("current"), F.lit(True).alias("auto_fixable"), F.col("s_name").alias("text"))
    return sinks.as_json(rows, False).withColumnRenamed("json", "bare").join(sinks.as_json(rows, True).withColumnRenamed("json", "whole"), "doc_id")


@query("""SELECT 'rules' AS kind, count(*) AS n, string_agg(DISTINCT p_partkey % 7 || 'r', ',' ORDER BY p_partkey % 7 || 'r') AS sample FROM part
    UNION ALL SELECT 'classification', count(*), '0.50' FROM part UNION ALL SELECT 'report', count(*), '0.5000' FROM part UNION ALL SELECT 'proposal', count(*), '0.5000' FROM part UNION ALL SELECT 'plan', count(*), '0.5000' FROM part""")
def artifacts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of JSON artifact written and read back strictly."""
    out = None
    for kind, schema in artifacts.SCHEMAS.items():
        fields = spark.createDataFrame([], schema).schema.fields
        made = []
        for f in fields:
            name, kind_of = f.name, f.dataType.simpleString()
            value = F.sha2(F.col("p_name"), 256) if name == "source_sha256" else F.concat((K() % 7).cast("string"), F.lit("r")) if kind_of == "string" else F.lit(None) if kind_of.startswith("struct") else F.array(F.lit("a")) if kind_of.startswith("array") else F.lit("0.5") if kind_of.startswith("decimal") else F.lit(True) if kind_of == "boolean" else K()
            made.append(value.cast(f.dataType).alias(name))
        path = stage_path(spark, f"artifact-{kind}")
        sinks.write_json(read(spark, sf_dir, "part").select(*made, F.col("p_size").alias("extra")), path)
        back = artifacts.read_artifact(spark, kind, path)
        sample = F.array_join(F.array_sort(F.collect_set("rule_id")), ",") if kind == "rules" else F.first(F.col("confidence").cast("string"))
        part = back.agg(F.count("*").alias("n"), sample.alias("sample")).select(F.lit(kind).alias("kind"), "n", "sample")
        out = part if out is None else out.union(part)
    return out


@query(f"""SELECT name, value FROM (VALUES {", ".join(f"('{n}', '{n}/')" for n in sinks.EXPORT_REQUIRED)}, ('layout_log', 'layout_log/'), ('second export', 'refused'), ('without the plan', 'refused'), ('rows', (SELECT count(*)::VARCHAR FROM part)),
    ('envelope', '{json.dumps(sinks.envelope("check", "passed", {"issues": 0}))}')) AS t(name, value)""")
def export_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle's manifest, its artifacts, and what may not be exported: to a place that is taken, or without a required artifact."""
    rows = read(spark, sf_dir, "part").select("p_partkey")
    bundle = dict.fromkeys([*sinks.EXPORT_REQUIRED, "layout_log"], rows)
    path = stage_path(spark, "bundle")
    sinks.export(bundle, path)
    refused = []
    for name, what, where in (("second export", bundle, path), ("without the plan", {k: v for k, v in bundle.items() if k != "plan"}, f"{path}-2")):
        try:
            sinks.export(what, where)
            refused.append((name, "written"))
        except Exception:  # noqa: BLE001
            refused.append((name, "refused"))
    manifest = spark.read.schema("artifact string, file string").json(f"{path}/manifest").toDF("name", "value")
    size = spark.read.parquet(f"{path}/post_check").agg(F.lit("rows").alias("name"), F.count("*").cast("string").alias("value"))
    said = [("envelope", json.dumps(sinks.envelope("check", "passed", {"issues": 0})))]
    return manifest.union(size).union(spark.createDataFrame(refused + said, "name string, value string"))


_HEAD = "<!doctype html><html><head><meta charset=utf-8><title>Format check</title></head><body><h1>Score "


@query(f"""WITH i AS (SELECT l_orderkey AS doc_id, string_agg('<tr><td>Error</td><td>r' || l_linenumber || '</td><td>p&lt;' || l_linenumber || '</td><td>' || CASE WHEN l_linenumber % 2 = 0 THEN '12.00 pt' ELSE 'unknown' END || '</td><td>yes</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, 0 AS l_partkey, 0 AS l_suppkey FROM lineitem) GROUP BY 1)
    SELECT o_orderkey AS doc_id, sha256('{_HEAD}' || o_orderkey % 100 || '</h1><h2>Issues</h2><table><tr><th>Severity<th>Rule<th>Place<th>Found<th>Expected</tr>' || coalesce(b, '') || '</table><h2>Pending elements</h2><table><tr><th>Element<th>Kind<th>Confidence</tr></table><h2>Skipped rules</h2><table><tr><th>Rule<th>Reason</tr>'
        || '<tr><td>r</td><td>why</td></tr></table></body></html>') AS digest FROM orders LEFT JOIN i ON doc_id = o_orderkey""")
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standalone page a document."""
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    n = F.col("l_linenumber")
    issues = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n).distinct().select("doc_id", F.lit("Error").alias("severity"), F.format_string("r%d", n).alias("rule_id"), F.format_string("p<%d", n).alias("path"), location(para_ix=n).alias("loc"), F.when(n % 2 == 0, "twip:240").alias("current"), F.lit("bool:True").alias("expected"))
    skips = docs.select("doc_id", F.lit("r").alias("rule_id"), F.lit("why").alias("reason"))
    pending = issues.limit(0).select("doc_id", F.lit("e").alias("element_id"), "loc", F.lit("Body").alias("kind"), F.lit(0.5).alias("confidence"))
    made = sinks.html_reports(docs, docs.select("doc_id", (F.col("doc_id") % 100).alias("score")), issues, skips, pending)
    return made.select("doc_id", F.sha2("html", 256).alias("digest"))


@query("""SELECT t.name || '.parquet' AS name, 'preflight.UnsupportedExtension' AS codes, false AS valid, NULL::BIGINT AS entries FROM (VALUES ('region'), ('nation')) AS t(name)""")
def preflight_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no packages, found by path; their size decides whether content is read at all."""
    out = None
    for name in ("region", "nation"):
        found = docx.preflight(docx.read_packages(spark, f"{sf_dir}/{name}.parquet", most=100)).select("path", F.array_join("codes", ",").alias("codes"), "valid", "entries")
        out = found if out is None else out.union(found)
    return out.select(F.regexp_extract("path", r"([a-z]+\.parquet)", 1).alias("name"), "codes", "valid", "entries").distinct()


_BROKEN = ["none", "no_archive", "truncated", "unsafe", "no_main", "extension"]


@query(f"""SELECT doc_id, {sql_pick(["", "preflight.InvalidZipSignature", "preflight.CorruptZip", "preflight.UnsafeEntryPath", "preflight.MissingMainDocument", "preflight.UnsupportedExtension"], "doc_id % 6")} AS codes, doc_id % 6 = 0 AS valid FROM documents""")
def preflight_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that are broken in five ways, checked as streams."""
    return docx.preflight(generate.broken_packages(read(spark, sf_dir, "documents"))).select("doc_id", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"), "valid")


@query("""WITH d AS (SELECT doc_id AS d FROM documents), s AS (SELECT d, unnest([0, 1]) AS section_ix FROM d)
    SELECT d AS doc_id, CAST(section_ix AS INTEGER) AS section_ix, CASE WHEN section_ix = 0 THEN NULL ELSE 12240 - d % 5 END AS width_tw, CASE WHEN section_ix = 0 THEN NULL ELSE 15840 END AS height_tw, CASE WHEN section_ix = 1 AND d % 2 = 0 THEN 'Landscape' ELSE 'Portrait' END AS orientation,
        CASE WHEN section_ix = 1 THEN 1000 + d % 7 END AS top_tw, CASE WHEN section_ix = 0 THEN 1 ELSE CAST(d % 3 + 1 AS INTEGER) END AS columns, CASE WHEN section_ix = 1 THEN 360 END AS gap_tw, CASE WHEN section_ix = 0 THEN 'continuous' END AS start, section_ix = 0 OR d % 2 = 1 AS equal_width, section_ix = 1 AS separator,
        CASE WHEN section_ix = 1 THEN 2 ELSE 0 END AS listed, CASE WHEN section_ix = 0 THEN 2 ELSE 1 END AS paragraphs, CASE WHEN section_ix = 0 THEN 0 ELSE 1 END AS tables FROM s""")
def docx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page settings and columns of packages with two sections, and what lies in each."""
    nodes = _rich(spark, sf_dir)
    rows = docx.table(nodes, "section").select("doc_id", "section_ix", "width_tw", "height_tw", "orientation", "top_tw", "columns", "gap_tw", "start", "equal_width", "separator", F.size("column_list").alias("listed"))
    p = docx.table(nodes, "paragraph").filter("table_ix is null").groupBy("doc_id", "section_ix").agg(F.count("*").cast("int").alias("paragraphs"))
    t = docx.table(nodes, "table").groupBy("doc_id", "section_ix").agg(F.count("*").cast("int").alias("tables"))
    return rows.join(p, ["doc_id", "section_ix"], "left").join(t, ["doc_id", "section_ix"], "left").na.fill(0, ["paragraphs", "tables"])


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(docx.nodes(generate.rich_packages(read(spark, sf_dir, "documents"))), "nodes", by="kind")


@query("""WITH d AS (SELECT doc_id AS d FROM documents)
    SELECT d AS doc_id, 'defaults' AS style_id, NULL AS kind, NULL AS based_on, NULL AS is_default, 'Base' || d % 3 AS font, (20 + d % 2) * 10 AS size_tw, NULL AS bold, NULL AS italic, 240 AS spacing_value, d % 5 * 10 AS after_tw, NULL AS first_line_tw, NULL AS align, NULL AS width_tw FROM d
    UNION ALL SELECT d, 'Normal', 'paragraph', NULL, true, NULL, (18 + d % 7) * 10, NULL, NULL, NULL, NULL, NULL, CASE WHEN d % 2 = 0 THEN 'Center' ELSE 'Left' END, NULL FROM d
    UNION ALL SELECT d, 'Lead', 'paragraph', 'Normal', false, NULL, NULL, d % 3 = 0, NULL, NULL, NULL, 100 * (d % 4), 'Justified', NULL FROM d UNION ALL SELECT d, 'Mark', 'character', NULL, false, NULL, NULL, NULL, true, NULL, NULL, NULL, NULL, NULL FROM d
    UNION ALL SELECT d, 'Grid', 'table', NULL, false, NULL, 160, NULL, NULL, NULL, NULL, NULL, NULL, 5000 + d % 9 FROM d""")
def docx_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets with their defaults; a second style of the same id does not count."""
    nodes = _rich(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    base = docx.table(nodes, "defaults").select("doc_id", F.lit("defaults").alias("style_id"), none("string").alias("kind"), none("string").alias("based_on"), none("boolean").alias("is_default"), "chr", "para", none(styles.struct_type(styles.TBL)).alias("tbl"))
    rows = base.unionByName(styles.first_definitions(docx.table(nodes, "style")).select(*base.columns))
    return rows.select("doc_id", "style_id", "kind", "based_on", "is_default", F.col("chr.font_ascii").alias("font"), F.col("chr.size_tw").alias("size_tw"), F.col("chr.bold").alias("bold"), F.col("chr.italic").alias("italic"), F.col("para.spacing_value").alias("spacing_value"), F.col("para.after_tw").alias("after_tw"),
        F.col("para.first_line_tw").alias("first_line_tw"), F.col("para.align").alias("align"), F.col("tbl.width_tw").alias("width_tw"))


@query("""WITH d AS (SELECT doc_id AS d FROM documents)
    SELECT d AS doc_id, 'main/section[0]/paragraph[0]/run[0]' AS path, 'lead ' || d AS text, CAST((18 + d % 7) * 10 AS BIGINT) AS size_tw, true AS bold, NULL AS italic, 'Base' || d % 3 AS font, true AS has_own FROM d
    UNION ALL SELECT d, 'main/section[0]/paragraph[0]/run[1]', 'link', (18 + d % 7) * 10, d % 3 = 0, true, 'Base' || d % 3, false FROM d UNION ALL SELECT d, 'main/section[0]/paragraph[1]/run[0]', 'plain', CASE WHEN d % 2 = 0 THEN 300 ELSE (18 + d % 7) * 10 END, NULL, NULL, 'Base' || d % 3, d % 2 = 0 FROM d
    UNION ALL SELECT d, 'main/section[1]/paragraph[0]/run[0]', 'end', (18 + d % 7) * 10, NULL, NULL, 'Base' || d % 3, false FROM d
    UNION ALL SELECT d, 'main/section[1]/table[0]/row[' || r || ']/cell[' || c || ']/paragraph[0]/run[0]', 'cell ' || r || c, (18 + d % 7) * 10, NULL, NULL, 'Base' || d % 3, false FROM d CROSS JOIN (VALUES (0, 0), (1, 0), (1, 1)) AS t(r, c)""")
def docx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of body and table paragraphs, also below links, with their effective formatting."""
    nodes = _rich(spark, sf_dir)
    found = styles.effective_runs(docx.table(nodes, "run"), docx.table(nodes, "style"), docx.table(nodes, "defaults"))
    return found.filter("text <> ''").select("doc_id", "path", "text", F.col("effective.size_tw").alias("size_tw"), F.col("effective.bold").alias("bold"), F.col("effective.italic").alias("italic"), F.col("effective.font_ascii").alias("font"), "has_own")


@query("""WITH d AS (SELECT doc_id AS d FROM documents) SELECT d AS doc_id, 'table' AS part, 'table[0]' AS place, 'Grid' AS style_id, 4000 + d % 9 AS width_tw, 'Center' AS align, d % 2 = 1 AS flag, NULL AS number FROM d
    UNION ALL SELECT d, 'row', 'row[0]', NULL, 300 + d % 4, NULL, true, NULL FROM d UNION ALL SELECT d, 'row', 'row[1]', NULL, NULL, NULL, NULL, NULL FROM d
    UNION ALL SELECT d, 'cell', 'row[0]/cell[0]', NULL, 4000, 'Center', NULL, 2 FROM d UNION ALL SELECT d, 'cell', 'row[1]/cell[0]', NULL, 2000, NULL, NULL, 1 FROM d UNION ALL SELECT d, 'cell', 'row[1]/cell[1]', NULL, NULL, 'Bottom', NULL, 1 FROM d""")
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, rows and cells of packages."""
    nodes = _rich(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    t = docx.table(nodes, "table").select("doc_id", F.lit("table").alias("part"), F.format_string("table[%d]", "table_ix").alias("place"), "style_id", F.col("direct.width_tw").alias("width_tw"), F.col("direct.align").alias("align"), F.col("direct.autofit").alias("flag"), none("int").alias("number"))
    r = docx.table(nodes, "row").select("doc_id", F.lit("row"), F.format_string("row[%d]", "row_ix"), none("string"), "height_tw", none("string"), "repeat_header", none("int"))
    c = docx.table(nodes, "cell").select("doc_id", F.lit("cell"), F.format_string("row[%d]/cell[%d]", "row_ix", "cell_ix"), none("string"), "width_tw", "v_align", none("boolean"), "grid_span")
    return t.union(r).union(c)


@query("""WITH d AS (SELECT doc_id AS d FROM documents), t(f, n) AS (VALUES ('paragraphs', 6), ('runs', 9), ('tables', 1), ('images', 1), ('equations', 1), ('hyperlinks', 1), ('bookmarks', 1), ('fields', 1), ('footnotes', 2), ('endnotes', 0))
    SELECT d AS doc_id, f AS feature, CAST(n AS BIGINT) AS n FROM d CROSS JOIN t""")
def docx_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a package's features; notes below id 0 do not count."""
    found = integrity.inventory(docx.table(_rich(spark, sf_dir), "feature"))
    return found.unpivot(["doc_id"], [c for c in found.columns if c != "doc_id"], "feature", "n")


_CODE = "length({0}) || ':' || {0} || ';'"


def _coded(*values: str) -> str:
    return "(" + " || ".join(_CODE.format(f"({v})") for v in values) + ")"


@query(f"""WITH d AS (SELECT doc_id AS d FROM documents)
    SELECT d AS doc_id, 'hyperlinks' AS check_id, {_coded("'rId1'", "'https://example.com/' || d", "''", "''", "'link'")} AS value FROM d UNION ALL SELECT d, 'bookmarks', {_coded("'start'", "'1'", "'Place'")} FROM d UNION ALL SELECT d, 'bookmarks', {_coded("'end'", "'1'")} FROM d
    UNION ALL SELECT d, 'fields', 'simple:PAGE' FROM d UNION ALL SELECT d, 'footnotes', n FROM d CROSS JOIN (VALUES ('-1:'), ('0:'), ('1:note')) AS t(n) UNION ALL SELECT d, 'section_topology', {_coded("'continuous'", "''", "''", "''", "'0'")} FROM d
    UNION ALL SELECT d, 'section_topology', {_coded("''", "(d % 3 + 1)::VARCHAR", "CASE WHEN d % 2 = 0 THEN '0' ELSE '1' END", "'1'", "'2'")} FROM d UNION ALL SELECT d, 'tables', {_coded(_coded("'cell 00'"), _coded("'cell 10'", "'cell 11'"))} FROM d""")
def docx_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items that versions are compared by."""
    rows = docx.table(_rich(spark, sf_dir), "content")
    return rows.filter(F.col("check_id").isin("hyperlinks", "bookmarks", "fields", "footnotes", "section_topology", "tables")).select("doc_id", "check_id", "value")


@query("""WITH d AS (SELECT doc_id AS d FROM documents), c(check_id) AS (VALUES ('normalized_body_text'), ('paragraph_sequence'), ('tables'), ('table_geometry'), ('effective_numbering'), ('numbering_definitions'), ('section_topology'), ('media'), ('equations'), ('hyperlinks'), ('bookmarks'), ('fields'), ('footnotes'),
        ('endnotes'), ('headers'), ('footers'), ('comments'), ('revisions'))
    SELECT d AS doc_id, check_id, CASE WHEN d % 7 = 0 OR d % 7 = 6 THEN 'Failed' WHEN d % 7 = 1 AND check_id IN ('normalized_body_text', 'paragraph_sequence') THEN 'Failed' WHEN d % 7 = 2 AND check_id = 'equations' THEN 'Failed' WHEN d % 7 = 3 AND check_id IN ('table_geometry') THEN 'Failed'
        WHEN d % 7 = 4 AND check_id = 'section_topology' THEN 'Failed' ELSE 'Passed' END AS status FROM d CROSS JOIN c""")
def integrity_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of packages through the whole comparison: some tampered with, some missing, some new."""
    from .engine import Documents, Engine

    docs = read(spark, sf_dir, "documents")
    before = Documents(generate.rich_packages(docs.filter("doc_id % 7 <> 6")))
    after = Documents(generate.rich_packages(docs.filter("doc_id % 7 <> 0"), tampered=True))
    return Engine(spark).validate_integrity(before, after).select("doc_id", "check_id", "status")


@query("""WITH d AS (SELECT doc_id AS d FROM documents)
    SELECT d AS doc_id, 'main/section[0]/paragraph[0]' AS path, 'lead ' || d || 'link' AS text, false AS in_table FROM d UNION ALL SELECT d, 'main/section[0]/paragraph[1]', 'plain', false FROM d UNION ALL SELECT d, 'main/section[1]/paragraph[0]', 'end', false FROM d
    UNION ALL SELECT d, 'main/section[1]/table[0]/row[' || r || ']/cell[' || c || ']/paragraph[0]', 'cell ' || r || c, true FROM d CROSS JOIN (VALUES (0, 0), (1, 0), (1, 1)) AS t(r, c)""")
def docx_paragraph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body and table paragraphs as one index by place."""
    rows = docx.table(_rich(spark, sf_dir), "paragraph")
    both = locations.body_and_table_paragraphs(rows.filter("table_ix is null"), rows.filter("table_ix is not null"))
    return both.select("doc_id", "path", "text", F.col("table_ix").isNotNull().alias("in_table"))


@query(f"""WITH d AS (SELECT doc_id AS d, doc_id % 5 AS kind FROM documents) SELECT d AS doc_id, {generate.FILTER_WIDTH} AS width, {generate.FILTER_HEIGHT} AS height, CAST({generate.FILTER_HEIGHT} * {generate.FILTER_WIDTH} // 2 AS BIGINT) AS ink FROM d""")
def png_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under each of the five line filters: headers read in SQL, pixels restored."""
    made = staged(generate.filtered_pages(read(spark, sf_dir, "documents").select("doc_id")), "pages")
    heads = png.headers(made.withColumn("path", F.col("doc_id").cast("string"))).select(F.col("path").cast("bigint").alias("doc_id"), "width", "height")
    ink = png.scanlines(made).groupBy("doc_id").agg(F.sum("ink").alias("ink"))
    return heads.join(ink, "doc_id")


@query("""WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS code, ['High', 'Low', 'Blocked', 'Medium'][l_partkey % 4 + 1] AS risk, l_partkey, l_suppkey FROM lineitem),
    s AS (SELECT doc_id, code, risk, count(*) AS k FROM f GROUP BY ALL)
    SELECT doc_id, code, risk, row_number() OVER (PARTITION BY doc_id ORDER BY CASE risk WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END, code) AS place,
        CASE WHEN bool_or(code % 7 = 0) OVER (PARTITION BY doc_id) THEN 'failed' WHEN bool_or(code % 3 = 0) OVER (PARTITION BY doc_id) THEN 'needsConfirmation' ELSE 'passed' END AS status FROM s""")
def visual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by risk, and what they say of a comparison."""
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("code"), pick(["High", "Low", "Blocked", "Medium"], F.col("l_partkey") % 4).alias("risk")).distinct()
    severity = F.when(F.col("code") % 7 == 0, "blocking").when(F.col("code") % 3 == 0, "review").otherwise("information")
    placed = pages.ordered_findings(rows, planning.RISKS)
    return placed.join(pages.comparison_status(rows, rows.withColumn("severity", severity)), "doc_id").select("doc_id", "code", "risk", F.col("place").cast("bigint").alias("place"), "status")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n).distinct()
    return rows.select(
        "doc_id", F.format_string("d%d", n).alias("directive_id"), F.format_string("g%d", F.when(n == 7, 6).otherwise(n)).alias("group_id"), F.format_string("r%d", n).alias("rule_id"), F.lit("rule").alias("scope"), pick(["Safe", "Review", "Advisory"], n % 3).alias("level"),
        F.when(n % 3 == 2, F.when(n == 5, "Apply").otherwise("ReportOnly")).otherwise("Apply").alias("decision"), F.lit("Low").alias("risk"), F.lit("0.90").cast("decimal(5,4)").alias("confidence"), (n == 3).alias("requires_confirmation"),
        F.when(n == 4, F.array(F.lit("g4"))).when(n == 2, F.array(F.lit("g99"))).otherwise(F.array().cast("array<string>")).alias("depends_on"), F.array(F.format_string("i%d", n)).alias("issue_ids"), F.lit("rep").alias("report_id"), F.lit("sha").alias("source_sha256"),
    )


_PLAN = "p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem)"


@query(f"""WITH {_PLAN} SELECT doc_id, 'd' || n AS directive_id, error FROM (SELECT doc_id, n, 'safe_needs_confirmation' AS error FROM p WHERE n = 3 UNION ALL SELECT doc_id, n, 'not_executable' FROM p WHERE n = 5 UNION ALL SELECT doc_id, n, 'self_dependency' FROM p WHERE n = 4
    UNION ALL SELECT doc_id, n, 'unknown_dependency' FROM p WHERE n = 2 UNION ALL SELECT doc_id, 6, 'duplicate_scope' FROM p WHERE n IN (6, 7) GROUP BY doc_id HAVING count(*) = 2)""")
def directive_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of repair plans."""
    return planning.directive_errors(_plan(spark, sf_dir))


@query(f"""WITH {_PLAN}, a AS (SELECT doc_id, n FROM p WHERE n % 3 = 0 OR n = 4 OR n % 3 = 1 AND n <> 4)
    SELECT a.doc_id, 'i' || n AS issue_id, 'rp-' || left(sha256('rep' || chr(31) || 'sha' || chr(31) || 'prov' || chr(31) || 'm' || chr(31) || body || chr(31)), 24) AS plan_id FROM a
    JOIN (SELECT doc_id, string_agg('g' || CASE WHEN n = 7 THEN 6 ELSE n END || ':' || CASE WHEN n % 3 = 2 AND n <> 5 THEN 'ReportOnly' ELSE 'Apply' END || ':Low:0.9000', '|' ORDER BY 'r' || n) AS body FROM p GROUP BY 1) b USING (doc_id) WHERE n % 2 = 1""")
def approved_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixable issues of the approved directives, with their plan's id."""
    plan = staged(_plan(spark, sf_dir), "plan")
    issues = plan.select("doc_id", F.col("issue_ids")[0].alias("issue_id"), (F.substring("directive_id", 2, 9).cast("int") % 2 == 1).alias("auto_fixable"))
    chosen = plan.filter("directive_id = 'd4'").select("doc_id", "directive_id")
    fixed = planning.approved_issues(plan, issues, planning.approvals(plan, chosen, True))
    return fixed.join(planning.plan_ids(plan, None, "prov", "m"), "doc_id").select("doc_id", "issue_id", "plan_id")


_HEAD, _LEAD, _PLAIN = "main/section[0]/paragraph[0]/run[0]", "main/section[0]/paragraph[0]", "main/section[0]/paragraph[1]"


@query("""SELECT doc_id, CAST(200 + doc_id % 3 * 20 AS BIGINT) AS size_tw, CASE WHEN doc_id % 2 = 0 THEN 'Justified' ELSE 'Center' END AS align, CAST(11000 + doc_id % 5 AS BIGINT) AS width_tw, CASE WHEN doc_id % 3 = 0 THEN 'New' ELSE 'Mark' END AS style_id,
    doc_id % 3 = 0 AS made, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS failed FROM documents""")
def package_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits written into packages, which are then read again: a size, an alignment, a page width, a style that may have to be made, and
    a place that some documents lack."""
    made = staged(generate.rich_packages(read(spark, sf_dir, "documents")), "rich")
    d = F.col("doc_id")
    rows = [
        (F.lit("FontSize"), F.lit(_HEAD), F.format_string("twip:%d", 200 + d % 3 * 20)), (F.lit("ParagraphAlignment"), F.lit(_LEAD), F.when(d % 2 == 0, "alignment:Justified").otherwise("alignment:Center")),
        (F.lit("PageWidth"), F.lit("main/section[1]"), F.format_string("twip:%d", 11000 + d % 5)), (F.lit("ParagraphStyleId"), F.lit(_PLAIN), F.when(d % 3 == 0, "text:New").otherwise("text:Mark")),
        (F.lit("Bold"), F.when(d % 4 == 0, F.lit("main/section[0]/paragraph[7]/run[0]")).otherwise(_HEAD), F.lit("bool:True")),
    ]
    edits = made.select("doc_id", F.posexplode(F.array(*[F.struct(p.alias("property"), at.alias("place"), v.alias("expected")) for p, at, v in rows])).alias("ord", "e")).select("doc_id", "ord", F.format_string("e%d", "ord").alias("edit_id"), "e.*")
    written = staged(packages.rewrite(made, edits, {"New": {"Bold": "True", "SpaceAfter": "60"}}), "written")
    found = staged(docx.nodes(written), "nodes", by="kind")
    run = docx.table(found, "run").filter(F.col("path") == _HEAD).select("doc_id", F.col("direct.size_tw").alias("size_tw"))
    paragraph = docx.table(found, "paragraph")
    lead = paragraph.filter(F.col("path") == _LEAD).select("doc_id", F.col("direct.align").alias("align"))
    plain = paragraph.filter(F.col("path") == _PLAIN).select("doc_id", "style_id")
    page = docx.table(found, "section").filter("section_ix = 1").select("doc_id", "width_tw")
    new = docx.table(found, "style").filter("style_id = 'New' and chr.bold and para.after_tw = 60 and based_on = 'Normal'").select("doc_id", F.lit(True).alias("made"))
    failed = written.select("doc_id", F.size(F.filter("log", lambda x: x["status"] == "Failed")).cast("bigint").alias("failed"))
    return run.join(lead, "doc_id").join(plain, "doc_id").join(page, "doc_id").join(failed, "doc_id").join(new, "doc_id", "left").na.fill({"made": False})


@query("""WITH d AS (SELECT doc_id, s FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS t(s) WHERE doc_id % 6 <> 0)
    SELECT doc_id, NULL AS section_ix, NULL AS columns, NULL AS gap_tw, NULL AS start, false AS ready FROM documents WHERE doc_id % 6 = 0 UNION ALL
    SELECT doc_id, CAST(s AS INTEGER) AS section_ix, CAST(CASE WHEN s = 2 THEN 2 ELSE 1 END AS INTEGER) AS columns, CAST(CASE s WHEN 1 THEN 0 WHEN 2 THEN 360 END AS BIGINT) AS gap_tw, CASE WHEN s <> 1 THEN 'continuous' END AS start, true AS ready FROM d""")
def package_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout operations written into packages: a section break and, in the section behind it, two columns; none where one of a
    document's operations has no target."""
    from .engine import Documents, Engine

    docs = read(spark, sf_dir, "documents")
    head = [F.lit("Apply").alias("decision"), F.lit("Review").alias("level")]
    cut = docs.select("doc_id", F.lit("z").alias("operation_id"), F.lit("InsertContinuousSectionBreak").alias("kind"), *head, F.lit("element:main/section[1]/paragraph[0]").alias("after_element_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("section_ix", "int"), ("columns", "int"), ("gap_tw", "bigint"))], F.array().cast("array<string>").alias("depends_on"))
    columns = docs.select("doc_id", F.lit("a"), F.lit("SetSectionColumns"), *head, F.lit(None).cast("string"), F.when(F.col("doc_id") % 6 == 0, 9).otherwise(2), F.lit(2), F.lit(360).cast("bigint"), F.array(F.lit("z")))
    made = Engine(spark).layout_apply(Documents(staged(generate.rich_packages(docs), "rich")), cut.union(columns))
    return made.gate.join(made.documents.sections, "doc_id", "left").select("doc_id", "section_ix", "columns", "gap_tw", "start", "ready")


@query("""WITH t AS (SELECT printf('t%06d', c_custkey) AS template_id, min(CASE c_custkey % 3 WHEN 0 THEN 'disabled' WHEN 1 THEN 'superseded' ELSE 'validated' END) AS g FROM customer GROUP BY 1)
    SELECT o_orderkey AS request, printf('t%06d', o_custkey + o_orderkey % 7 * 100000) AS template_id, CASE WHEN g IS NULL THEN 'not_found' WHEN g <> 'validated' THEN 'unavailable' ELSE 'resolved' END AS status
    FROM orders LEFT JOIN t ON t.template_id = printf('t%06d', o_custkey + o_orderkey % 7 * 100000)""")
def template_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for templates by their own ids."""
    c = F.col("c_custkey")
    known = read(spark, sf_dir, "customer").select(F.format_string("t%06d", c).alias("template_id"), pick(["disabled", "superseded", "validated"], c % 3).alias("status"))
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.format_string("t%06d", F.col("o_custkey") + F.col("o_orderkey") % 7 * 100000).alias("template_id"))
    return venues.select_templates(asked, known)

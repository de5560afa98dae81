"""Queries over the driver's tables, one or more for each family of operators, with their SQL.

Where the tables hold nothing like manuscripts, operators are bound to columns of the same shape: style chains to parts,
sections to nations, versions of a document to conversations, and so on. All of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import predicates as P
from folioscan.functions import text as T
from folioscan.functions import units as U
from folioscan.operators import check as C
from folioscan.operators import classify as L
from folioscan.operators import integrity, layout, pages, planning, repair, rules, styles, venues
from folioscan.operators import relational as R
from folioscan.operators.locations import canonical_path, location
from folioscan.sources import docx, generate, png
from folioscan.sources.manuscript import MANUSCRIPT_SQL, manuscript

from . import classify_sql as Q
from .staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).filter("line <> ''")


LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
LENGTH_RULES = "[length(line) >= 40, length(line) <= 400, right(line, 1) = '.']"


def _length_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line")
    tests = [("short-line", "Error", n >= 40), ("long-line", "Warning", n <= 400), ("no-period", "Information", F.substring("line", -1, 1) == ".")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), c.alias("passed")) for r, s, c in tests])
    return _lines(spark, sf_dir).select("doc_id", F.explode(rows).alias("o")).select("doc_id", "o.*")


@query(f"""WITH {LINES}, o AS (SELECT doc_id, unnest({LENGTH_RULES}) AS passed FROM lines WHERE line <> '')
    SELECT doc_id, count(*) AS observations, count_if(passed)::BIGINT AS passed, CAST(round(count_if(passed) * 100::DECIMAL(20,0) / count(*), 0) AS INTEGER) AS score FROM o GROUP BY doc_id""")
def score_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules joined with paragraphs, observation counts, score."""
    seen = _length_observations(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("observations"), F.count_if("passed").alias("passed"))
    return seen.withColumn("score", C.score(F.col("passed"), F.col("observations")))


@query(f"""WITH {LINES}, o AS (SELECT unnest([{{'s': 'Error', 'p': length(line) >= 40}}, {{'s': 'Warning', 'p': length(line) <= 400}}, {{'s': 'Information', 'p': right(line, 1) = '.'}}]) AS x FROM lines WHERE line <> '')
    SELECT x.s AS severity, count(*) AS issues FROM o WHERE NOT x.p GROUP BY 1""")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _length_observations(spark, sf_dir).filter("not passed").groupBy("severity").agg(F.count("*").alias("issues"))


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manuscripts and their elements, each made once: what follows reads both several times."""
    rows = staged(manuscript(read(spark, sf_dir, "documents")), "manuscripts")
    return rows, staged(L.classify(rows).drop("reasons"), "elements")


@query(f"WITH {Q.ELEMENTS_SQL} SELECT doc_id, path, kind, conf / 100::DOUBLE AS confidence, status FROM elements")
def classify_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, scores, ranking and decision for every paragraph."""
    return L.classify(manuscript(read(spark, sf_dir, "documents"))).select("doc_id", "path", "kind", F.col("confidence").cast("double").alias("confidence"), "status")


@query(f"WITH {Q.ELEMENTS_SQL} SELECT kind, status, count(*) AS n FROM elements GROUP BY ALL")
def classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classify(manuscript(read(spark, sf_dir, "documents"))).groupBy("kind", "status").agg(F.count("*").alias("n"))


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, elements = _elements(spark, sf_dir)
    para = F.struct("align", F.lit(None).cast("string").alias("spacing_kind"), *[F.lit(None).cast("bigint").alias(c) for c in ("spacing_value", "before_tw", "after_tw", "first_line_tw")])
    fonts = F.struct(F.lit("TIMES NEW ROMAN").alias("font_ascii"), F.lit("Arial").alias("font_hansi"), F.lit(" ").alias("font_ea"), F.lit(None).cast("string").alias("font_cs"), "size_tw", "bold", "italic")
    paragraphs = rows.withColumn("effective", para).withColumn("has_direct", F.lit(False))
    runs = rows.select("doc_id", F.col("path").alias("para_path"), F.col("loc").withField("run_ix", F.lit(0)).alias("loc"), "text", fonts.alias("effective"))
    package = rules.builtin_rules(spark).filter("target <> 'Page' and property <> 'CaptionNumberSequence'")
    none = spark.createDataFrame([], "doc_id bigint, section_ix int, width_tw bigint, height_tw bigint, orientation string, top_tw bigint, right_tw bigint, bottom_tw bigint, left_tw bigint, columns int, gap_tw bigint").filter("false")
    return C.observations(none, paragraphs, runs, elements, package), elements


@query(f"WITH {Q.OBSERVED_SQL} SELECT doc_id, count(*) AS observations, count_if(passed)::BIGINT AS passed, CAST(round(count_if(passed) * 100::DECIMAL(20,0) / count(*), 0) AS INTEGER) AS score FROM observed GROUP BY doc_id")
def check_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in text rules against classified manuscripts."""
    seen = _observed(spark, sf_dir)[0].groupBy("doc_id").agg(F.count("*").alias("observations"), F.count_if("passed").alias("passed"))
    return seen.withColumn("score", C.score(F.col("passed"), F.col("observations")))


@query(f"""WITH {Q.OBSERVED_SQL} SELECT doc_id, rule_id, place AS path, current, expected,
    'issue-' || left(sha256(rule_id || '|' || place || '|' || coalesce(current, 'unknown') || '|' || expected), 20) AS issue_id FROM observed WHERE NOT passed""")
def check_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.issues(_observed(spark, sf_dir)[0]).select("doc_id", "rule_id", "path", "current", "expected", "issue_id")


_SCOPE = """CASE WHEN target = 'TableText' THEN 'table:MainDocument::0:' WHEN property IN ('FirstLineIndent', 'ParagraphStyleId') OR target IN ('Title', 'Heading1', 'Heading2', 'Heading3', 'FigureCaption', 'TableCaption')
    THEN 'element:' || place ELSE 'rule' END"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staged(C.issues(_observed(spark, sf_dir)[0]), "issues")
    reports = found.select("doc_id").distinct().withColumn("report_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")))
    return staged(planning.candidate_groups(found, reports), "groups")


_GROUPS = f"""{Q.OBSERVED_SQL}, issue AS (SELECT *, {_SCOPE} AS scope, 'issue-' || left(sha256(rule_id || '|' || place || '|' || coalesce(current, 'unknown') || '|' || expected), 20) AS issue_id FROM observed WHERE NOT passed),
    grouped AS (SELECT doc_id, rule_id, target, property, scope, count(*) AS issues, bool_and(property <> 'ParagraphStyleId' AND property <> 'DirectFormattingConsistency') AS all_fixable,
        'rp-' || left(sha256('r' || doc_id || chr(31) || rule_id || chr(31) || scope), 24) AS group_id FROM issue GROUP BY doc_id, rule_id, target, property, scope)"""


@query(f"WITH {_GROUPS} SELECT doc_id, group_id, rule_id, scope, issues FROM grouped")
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("doc_id", "group_id", "rule_id", "scope", F.size("issue_ids").cast("bigint").alias("issues"))


@query(f"""WITH {_GROUPS}, p AS (SELECT *, issues % 5 <> 0 AS proposed, 0.70 + 0.05 * (length(rule_id) % 7) AS conf, CASE WHEN length(scope) % 3 = 0 THEN 'Medium' ELSE 'Low' END AS r0 FROM grouped),
    d AS (SELECT *, CASE WHEN NOT proposed THEN 'ReportOnly' WHEN NOT all_fixable THEN 'ReportOnly' WHEN property = 'ParagraphStyleId' THEN 'Preserve'
        WHEN target = 'TableText' AND property IN ('ParagraphAlignment', 'LineSpacing', 'SpaceBefore', 'SpaceAfter') THEN 'Preserve' WHEN conf < 0.80 THEN 'ReportOnly' ELSE 'Apply' END AS decision FROM p),
    f AS (SELECT *, CASE WHEN NOT proposed THEN 'High' WHEN decision = 'Apply' THEN r0 WHEN NOT all_fixable OR decision = 'Preserve' THEN 'Blocked' ELSE 'High' END AS risk FROM d)
    SELECT decision, risk, CASE WHEN decision <> 'Apply' THEN 'Advisory' WHEN risk <> 'Low' THEN 'Review' ELSE 'Safe' END AS level, count(*) AS n FROM f GROUP BY ALL""")
def policy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for most groups, and what policy makes of them."""
    groups = _groups(spark, sf_dir)
    proposals = groups.filter(F.size("issue_ids") % 5 != 0).select(
        "doc_id", "group_id", F.lit("Apply").alias("decision"), F.when(F.length("scope") % 3 == 0, "Medium").otherwise("Low").alias("risk"), (F.lit(70) + 5 * (F.length("rule_id") % 7)).cast("decimal(10,4)").alias("confidence"),
        F.array().cast("array<string>").alias("depends_on"), F.lit("discardCandidateCopy").alias("rollback"),
    ).withColumn("confidence", (F.col("confidence") / 100).cast("decimal(5,4)"))
    return planning.directives(groups, proposals, True).groupBy("decision", "risk", "level").agg(F.count("*").alias("n"))


@query(f"""WITH {MANUSCRIPT_SQL}, x AS (SELECT doc_id, path, {Q.trim("text")} AS t FROM manuscript)
    SELECT doc_id, path, {Q.ABSTRACT} AS abstract, {Q.KEYWORDS} AS keywords, {Q.FIGURE} AS figure, {Q.TABLE} AS table_caption, {Q.REFERENCES} AS references_heading, {Q.ENTRY} AS entry,
        {Q.heading1("t")} AS heading1, {Q.heading2("t")} AS heading2, {Q.heading3("t")} AS heading3 FROM x""")
def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    tests = {"abstract": P.is_abstract, "keywords": P.is_keywords, "figure": P.is_figure_caption, "table_caption": P.is_table_caption, "references_heading": P.is_references_heading, "entry": P.is_reference_entry, "heading1": P.is_heading1, "heading2": P.is_heading2, "heading3": P.is_heading3}
    return manuscript(read(spark, sf_dir, "documents")).select("doc_id", "path", *[f(t).alias(k) for k, f in tests.items()])


@query(f"""WITH {Q.ELEMENTS_SQL}, e AS (SELECT doc_id, max(CASE WHEN kind IN ('Title', 'Author', 'Affiliation', 'Abstract', 'Keywords') THEN pos END) AS fe FROM elements GROUP BY 1),
    b AS (SELECT doc_id, fe, (SELECT min(pos) FROM elements x WHERE x.doc_id = e.doc_id AND x.kind IN ('Heading1', 'Body') AND (fe IS NULL OR x.pos > fe)) AS bs FROM e)
    SELECT doc_id, 'element:main/section[0]/paragraph[' || fe || ']' AS front_end, 'element:main/section[0]/paragraph[' || bs || ']' AS body_start FROM b""")
def front_matter_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.boundary(L.classify(manuscript(read(spark, sf_dir, "documents"))))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(title|h1|h2|h3|p|li)[ >]', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def html_block_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.regexp_extract_all("html", F.lit(r"<(title|h1|h2|h3|p|li)[ >]"), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", tags.alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS expected FROM lineitem)
    SELECT l_orderkey, count(*) AS lines, count_if(l_linenumber = expected)::BIGINT AS in_sequence FROM s GROUP BY 1""")
def caption_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.sequence_breaks(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_linenumber")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if("in_sequence").alias("in_sequence"))


_NUMERALS = ["I", "IV", "XIX", "MCMXC", "ic", "12b", "A1", ""]
_WORTH = "CASE {} WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"


@query(f"""WITH x AS (SELECT p_partkey, [{", ".join(f"'{n}'" for n in _NUMERALS)}][p_partkey % 8 + 1] AS token FROM part),
    c AS (SELECT p_partkey, token, unnest(range(1, length(token) + 1)) AS i FROM x),
    v AS (SELECT p_partkey, i, {_WORTH.format("upper(token[i])")} AS w, coalesce({_WORTH.format("upper(token[i + 1])")}, 0) AS nxt FROM c),
    r AS (SELECT p_partkey, CASE WHEN min(w) = 0 THEN NULL ELSE sum(CASE WHEN w < nxt THEN -w ELSE w END) END AS roman FROM v GROUP BY 1)
    SELECT x.p_partkey, 'Table ' || token || ': parts' AS caption, CAST(coalesce(TRY_CAST(nullif(regexp_extract(token, '^[0-9]+'), '') AS INTEGER), CASE WHEN roman > 0 THEN roman END) AS INTEGER) AS number
    FROM x LEFT JOIN r ON x.p_partkey = r.p_partkey""")
def roman_caption_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Table "), F.element_at(F.array(*map(F.lit, _NUMERALS)), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(": parts")).alias("caption"))
    return rows.withColumn("number", T.caption_number(F.col("caption"), F.lit("TableCaption")))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1")
def uniform_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(R.uniform(F.col("l_returnflag")).alias("flag"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS next_n FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag NULLS FIRST))
    SELECT l_orderkey, l_returnflag, n, coalesce(next_n = n, false) AS tie FROM r WHERE k = 1""")
def modal_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value of each key and whether another is as common."""
    return R.modal(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""WITH j AS (SELECT o_custkey, o_orderkey, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT o_custkey, o_orderkey, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS v FROM j GROUP BY ALL)
    SELECT o_custkey, CASE WHEN max(n) = 1 AND count(DISTINCT v) = 1 THEN min(v) END AS consensus FROM m GROUP BY 1""")
def consensus_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.consensus(rows, ["o_custkey"], "o_orderkey", "l_linestatus")


def _part_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {k: F.lit(None).cast(styles.struct_type(f)) for k, f in (("para", styles.PARA), ("tbl", styles.TBL))}
    size = F.struct(*[(F.col("p_size").cast("bigint") if f == "size_tw" else F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") > 25) if f == "bold" else F.lit(None)).cast("boolean" if f in ("bold", "italic", "caps", "small_caps") else "bigint" if f == "size_tw" else "string").alias(f) for f in styles.CHR])
    k = F.col("p_partkey")
    # a style sheet for every 64 parts; a part's style is based on half its place, and the style at 0 of every third sheet on its place 5: a cycle
    sheet, place = F.floor(k / 64), k % 64
    base = F.when((place == 0) & (sheet % 3 == 0), 5).when(place > 0, F.floor(place / 2))
    return read(spark, sf_dir, "part").select(sheet.alias("doc_id"), place.cast("string").alias("style_id"), place.alias("ord"), F.col("p_name").alias("name"), F.lit("paragraph").alias("kind"), base.cast("string").alias("based_on"), F.lit(None).cast("string").alias("linked"),
        F.lit(False).alias("is_default"), F.when(place % 2 == 0, size).alias("chr"), none["para"].alias("para"), none["tbl"].alias("tbl"))


_SHEETS = """RECURSIVE s AS (SELECT p_partkey // 64 AS doc_id, p_partkey % 64 AS id, CASE WHEN p_partkey % 64 = 0 THEN CASE WHEN (p_partkey // 64) % 3 = 0 THEN 5 END ELSE (p_partkey % 64) // 2 END AS base, p_size, p_partkey FROM part),
    known AS (SELECT s.doc_id, s.id, b.id AS base FROM s LEFT JOIN s b ON b.doc_id = s.doc_id AND b.id = s.base),
    up(doc_id, id, anc, depth) AS (SELECT doc_id, id, id, 0 FROM s UNION ALL SELECT up.doc_id, up.id, k.base, depth + 1 FROM up JOIN known k ON k.doc_id = up.doc_id AND k.id = up.anc WHERE k.base IS NOT NULL AND depth < 16)"""


@query(f"WITH {_SHEETS}, f AS (SELECT doc_id, id, anc, min(depth) AS depth FROM up GROUP BY ALL) SELECT doc_id, CAST(id AS VARCHAR) AS style_id, CAST(anc AS VARCHAR) AS ancestor, depth FROM f")
def style_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.ancestors(_part_styles(spark, sf_dir))


@query(f"WITH {_SHEETS} SELECT DISTINCT doc_id, CAST(id AS VARCHAR) AS style_id FROM up WHERE depth > 0 AND id = anc")
def style_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.cycles(_part_styles(spark, sf_dir))


@query(f"""WITH {_SHEETS}, ring AS (SELECT DISTINCT doc_id, id FROM up WHERE depth > 0 AND id = anc),
    f AS (SELECT u.doc_id, u.id, u.anc, min(u.depth) AS depth FROM up u WHERE NOT EXISTS (
        SELECT 1 FROM up v JOIN ring r ON r.doc_id = v.doc_id AND r.id = v.anc WHERE v.doc_id = u.doc_id AND v.id = u.id AND v.depth < u.depth) GROUP BY u.doc_id, u.id, u.anc),
    own AS (SELECT doc_id, id, CAST(p_size AS BIGINT) AS size_tw, CASE WHEN p_partkey % 3 = 0 THEN p_size > 25 END AS bold FROM s WHERE id % 2 = 0)
    SELECT f.doc_id, CAST(f.id AS VARCHAR) AS style_id, arg_min(o.size_tw, f.depth) FILTER (o.size_tw IS NOT NULL) AS size_tw, arg_min(o.bold, f.depth) FILTER (o.bold IS NOT NULL) AS bold
    FROM f LEFT JOIN own o ON o.doc_id = f.doc_id AND o.id = f.anc GROUP BY f.doc_id, f.id""")
def style_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inherited character formatting, with cycle members cut from their base."""
    return styles.contributions(_part_styles(spark, sf_dir)).select("doc_id", "style_id", F.col("chr.size_tw").alias("size_tw"), F.col("chr.bold").alias("bold"))


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_regionkey % 2 = 0 THEN r_name END, 'default') AS label,
    coalesce(CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey END, CASE WHEN n_regionkey <> 1 THEN r_regionkey * 100 END, -1)::BIGINT AS code FROM nation JOIN region ON n_regionkey = r_regionkey""")
def overlay_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers, each field from the strongest that has it."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def layer(label, code):
        return F.struct(label.alias("label"), code.cast("bigint").alias("code"))

    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    made = R.layered([layer(F.lit("default"), F.lit(-1)), layer(F.when(r % 2 == 0, F.col("r_name")), F.when(r != 1, F.col("r_regionkey") * 100)), layer(F.when(n % 3 == 0, F.col("n_name")), F.when(n % 4 == 0, n))], ["label", "code"])
    return rows.select("n_nationkey", made["label"].alias("label"), made["code"].alias("code"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", "paragraph_sequence").otherwise("fields").alias("check_id"), F.col("turn").alias("ord"), F.coalesce("text", F.lit("")).alias("value"))
    edited = rows.withColumn("value", F.when((F.col("doc_id") % 7 == 0) & (F.col("ord") == 0), F.concat("value", F.lit("!"))).otherwise(F.col("value"))).filter("not (doc_id % 11 = 0 and ord = 1)")
    return rows, edited


_CODED = """SELECT conv_id AS doc_id, CASE WHEN role = 'user' THEN 'paragraph_sequence' ELSE 'fields' END AS check_id, count(*) AS n,
    sha256(string_agg(length({v}) || ':' || {v} || ';', '' ORDER BY turn, {v})) AS digest FROM conversations {w} GROUP BY 1, 2"""


@query(_CODED.format(v="coalesce(text, '')", w=""))
def integrity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sequence_digest(_versions(spark, sf_dir)[0], ["doc_id", "check_id"], "ord", "value")


_EDIT = "(CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END)"


@query(f"""WITH a AS ({_CODED.format(v="coalesce(text, '')", w="")}), b AS ({_CODED.format(v=_EDIT, w="WHERE NOT (conv_id % 11 = 0 AND turn = 1)")}),
    docs AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), checks AS (SELECT unnest([{", ".join(f"'{c}'" for c in integrity.CHECKS)}]) AS check_id),
    c AS (SELECT d.doc_id, check_id, coalesce(a.n, 0) = coalesce(b.n, 0) AND coalesce(a.digest, '') = coalesce(b.digest, '') OR check_id = 'fields' AND d.doc_id % 2 < 0 AS same
        FROM docs d CROSS JOIN checks LEFT JOIN a USING (doc_id, check_id) LEFT JOIN b USING (doc_id, check_id))
    SELECT doc_id, CASE WHEN bool_and(same) THEN 'Passed' ELSE 'Failed' END AS status, count_if(NOT same)::BIGINT AS failed FROM c GROUP BY 1""")
def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two versions, compared by check and rolled up."""
    rows, edited = _versions(spark, sf_dir)
    docs = rows.select("doc_id")
    return integrity.integrity_report(integrity.compare(integrity.snapshot(rows, docs), integrity.snapshot(edited, docs))).select("doc_id", "status", "failed")


@query("""WITH h AS (SELECT event_type, event_id >= (SELECT max(event_id) / 2 FROM events) AS late FROM events)
    SELECT event_type, count(*) AS surplus FROM (SELECT event_type FROM h WHERE late EXCEPT ALL SELECT event_type FROM h WHERE NOT late) GROUP BY 1""")
def multiset_new_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    half = rows.agg(F.max("event_id")).first()[0] / 2
    return R.multiset_surplus(rows.filter(F.col("event_id") >= half).select("event_type"), rows.filter(F.col("event_id") < half).select("event_type")).groupBy("event_type").agg(F.count("*").alias("surplus"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
    g AS (SELECT user_id, island, count_if(event_type <> 'error') AS run FROM r GROUP BY ALL) SELECT user_id, max(run)::BIGINT AS longest FROM g GROUP BY 1""")
def longest_blank_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_run(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") != "error")


def _renderings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.floor(F.col("page_id") / 20).cast("int").alias("page_no"), (F.length("html") % 3).alias("width"), F.lit(100).alias("height"), F.sha2("url", 256).alias("sha256"),
        ((F.length("html") % 10) * 0.00001).alias("ink_ratio"), ((F.length("html") % 100) / 100).alias("blank_ratio"))
    return rows.filter("page_no % 2 = 0"), rows.filter("page_no % 2 = 1 or doc_id % 5 = 0")


@query("""WITH p AS (SELECT page_id % 20 AS doc_id, page_id // 20 AS page_no, length(html) % 3 AS width, sha256(url) AS sha, (length(html) % 10) * 0.00001 AS ink, (length(html) % 100) / 100 AS blank FROM pages),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p WHERE page_no % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p WHERE page_no % 2 = 1 OR doc_id % 5 = 0),
    n AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM (SELECT doc_id, count(*) AS n0 FROM l GROUP BY 1) a FULL JOIN (SELECT doc_id, count(*) AS n1 FROM r GROUP BY 1) b ON a.doc_id = b.doc_id)
    SELECT doc_id, 'page_count_changed' AS code, 'information' AS severity, CAST(nullif(n0, 0) AS INTEGER) AS before_page, CAST(nullif(n1, 0) AS INTEGER) AS after_page FROM n WHERE n0 <> n1
    UNION ALL SELECT l.doc_id, 'page_dimensions_changed', 'review', CAST(k AS INTEGER), CAST(k AS INTEGER) FROM l JOIN r USING (doc_id, k) WHERE l.width <> r.width
    UNION ALL SELECT l.doc_id, 'page_pixels_changed', 'information', CAST(k AS INTEGER), CAST(k AS INTEGER) FROM l JOIN r USING (doc_id, k) WHERE l.sha <> r.sha
    UNION ALL SELECT l.doc_id, 'large_blank_region_introduced', 'blocking', CAST(k AS INTEGER), CAST(k AS INTEGER) FROM l JOIN r USING (doc_id, k) WHERE r.blank >= 0.45 AND l.blank < 0.45
    UNION ALL SELECT r.doc_id, 'mostly_blank_page_introduced', 'blocking', NULL, CAST(r.page_no AS INTEGER) FROM r LEFT JOIN l USING (doc_id, k) WHERE l.k IS NULL AND r.ink < 0.00005""")
def page_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two renderings whose pages pair by order."""
    return pages.compare_pages(*_renderings(spark, sf_dir))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k FROM part), e AS (SELECT k, k // 2 AS need FROM n WHERE k // 2 > 0 UNION SELECT k, k // 3 FROM n WHERE k // 3 > 0),
    d(k, round) AS (SELECT k, 0 FROM n UNION SELECT e.k, d.round + 1 FROM d JOIN e ON e.need = d.k)
    SELECT k AS p_partkey, max(round) AS round FROM d GROUP BY 1""")
def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of a dependency graph: a part needs its half and its third."""
    nodes = read(spark, sf_dir, "part").select("p_partkey")
    edges = None
    for by in (2, 3):
        part = nodes.select("p_partkey", F.floor(F.col("p_partkey") / by).alias("need")).filter("need > 0")
        edges = part if edges is None else edges.union(part)
    return R.topological_levels(nodes, edges, "p_partkey", "need")


@query("""WITH RECURSIVE c(node, ancestor, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, ancestor // 2, depth + 1 FROM c WHERE ancestor // 2 > 0)
    SELECT node, ancestor, depth FROM c""")
def chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of parts whose parent is their half, by joins that double their reach."""
    k = F.col("p_partkey")
    return R.closure(read(spark, sf_dir, "part").select(k.alias("n"), F.when(k > 1, F.floor(k / 2)).alias("up")), "n", "up")


@query("""SELECT p_partkey, greatest(1, CAST(trunc((12240 - 10 * p_size - 20 * (p_size % 7) - (p_size % 4) * 360) / CAST(p_size % 4 + 1 AS DOUBLE)) AS BIGINT)) AS width_tw, CAST(floor(p_retailprice * 10000) AS BIGINT) // 635 AS emu_tw FROM part""")
def column_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    wide = U.column_width(F.lit(12240), s * 10, s % 7 * 20, s % 4 + 1, F.lit(360))
    return read(spark, sf_dir, "part").select("p_partkey", wide.alias("width_tw"), U.twips_from_emu(F.floor(F.col("p_retailprice") * 10000)).alias("emu_tw"))


_PRICE = "CAST(round(p_retailprice, 2) AS DECIMAL(12,2))"


@query(f"""SELECT p_partkey, CAST(round({_PRICE} * 20, 0) AS BIGINT) AS from_points, CAST(round({_PRICE} * 1440, 0) AS BIGINT) AS from_inches, CAST(round({_PRICE} * 1440 / 2.54::DOUBLE, 0) AS BIGINT) AS from_cm,
    CAST(round({_PRICE} * 1440 / 25.4::DOUBLE, 0) AS BIGINT) AS from_mm, CAST({_PRICE} * 240 AS BIGINT) AS line, CAST(p_size / 20::DOUBLE AS DOUBLE) AS points, CASE WHEN p_size % 10 = 0 THEN CAST(p_size // 10 AS VARCHAR) END AS half_points FROM part""")
def twip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round("p_retailprice", 2).cast("decimal(12,2)")
    size = F.col("p_size").cast("bigint")
    return read(spark, sf_dir, "part").select("p_partkey", U.twips_from_points(p).alias("from_points"), U.twips_from_inches(p).alias("from_inches"), U.twips_from_centimetres(p).alias("from_cm"), U.twips_from_millimetres(p).alias("from_mm"),
        U.line_multiple(p).cast("bigint").alias("line"), U.points(size).cast("double").alias("points"), U.half_points(size).alias("half_points"))


_RULE_ROWS = ", ".join(str((f"{rules.PROFILE}.{rules.slug(t)}.{rules.slug(p)}", v)) for t in rules.TEXT for p, v in rules._text_values(t).items())


@query(f"""WITH r(rule_id, expected) AS (VALUES {_RULE_ROWS}), e AS (SELECT rule_id, CASE WHEN length(rule_id) % 4 = 0 THEN 'twip:' || length(rule_id) END AS v, CASE WHEN length(rule_id) % 3 = 0 THEN false END AS enabled FROM r WHERE length(rule_id) % 2 = 0)
    SELECT r.rule_id, coalesce(e.v, r.expected) AS expected, coalesce(e.enabled, true) AS enabled, CASE WHEN e.rule_id IS NULL THEN 'profile:{rules.PROFILE}' ELSE 'user-override' END AS evidence, 2 AS revision FROM r LEFT JOIN e USING (rule_id)""")
def override_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = rules.builtin_rules(spark).filter(F.col("target").isin(list(rules.TEXT)) & ~F.col("property").isin("FirstLineIndent", "DirectFormattingConsistency", "CaptionNumberSequence"))
    n = F.length("rule_id")
    edits = package.filter(n % 2 == 0).select("rule_id", F.when(n % 4 == 0, F.concat(F.lit("twip:"), n.cast("string"))).alias("expected"), F.when(n % 3 == 0, F.lit(False)).alias("enabled"))
    return rules.override_rules(package, edits).select("rule_id", "expected", "enabled", "evidence", "revision")


_ALIASES = "alias AS (SELECT DISTINCT lower(p_name) AS key, min(p_brand) OVER (PARTITION BY lower(p_name)) AS family FROM part UNION SELECT DISTINCT w, 'word ' || w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w NOT IN (SELECT lower(p_name) FROM part))"
_QUERIES_SQL = "q AS (SELECT p_partkey AS query, lower(p_name) || CASE p_partkey % 3 WHEN 0 THEN ' 2027 main track' WHEN 1 THEN ' x' ELSE '' END AS q FROM part)"


def _venues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    whole = part.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_brand").alias("family"))
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("key")).distinct().join(whole.select("key"), "key", "left_anti").select("key", F.concat(F.lit("word "), "key").alias("family"))
    m = F.col("p_partkey") % 3
    queries = part.select(F.col("p_partkey").alias("query"), F.concat(F.lower("p_name"), F.when(m == 0, " 2027 main track").when(m == 1, " x").otherwise("")).alias("q"))
    return queries, whole.union(words)


@query(f"""WITH {_ALIASES}, {_QUERIES_SQL}, m AS (SELECT query, key, family FROM q JOIN alias ON contains(' ' || q || ' ', ' ' || key || ' ')),
    l AS (SELECT query, key, family FROM m QUALIFY length(key) = max(length(key)) OVER (PARTITION BY query))
    SELECT query, min(family) AS family, min(key) AS key FROM l GROUP BY 1 HAVING count(DISTINCT family) = 1""")
def alias_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue routing: the longest alias that a query holds as whole words."""
    return venues.longest_match(venues.phrase_matches(*_venues(spark, sf_dir)))


@query(f"""WITH {_ALIASES}, {_QUERIES_SQL}, qw AS (SELECT DISTINCT query, unnest(string_split(q, ' ')) AS word FROM q), aw AS (SELECT DISTINCT key, family, unnest(string_split(key, ' ')) AS word FROM alias),
    s AS (SELECT query, family, key, count(*) AS n FROM qw JOIN aw USING (word) GROUP BY ALL), b AS (SELECT query, family, max(n) AS score FROM s GROUP BY ALL)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, upper(family)) AS INTEGER) AS rank, family, score FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, upper(family)) <= 5""")
def alias_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, aliases = _venues(spark, sf_dir)
    return venues.suggestions(queries, aliases, aliases.select("family", F.upper("family").alias("display_name")).distinct())


@query(r"""WITH s AS (SELECT s_suppkey, regexp_extract(s_name, '(\d+)', 1) AS d FROM supplier), c AS (SELECT c_custkey, regexp_extract(c_name, '(\d+)', 1) AS d FROM customer)
    SELECT s_suppkey, count(c_custkey) AS matches, CASE count(c_custkey) WHEN 0 THEN 'needs_exact_template' WHEN 1 THEN 'resolved' ELSE 'error' END AS status FROM s LEFT JOIN c USING (d) GROUP BY s_suppkey""")
def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a registry by normalised identity, never in part."""
    def key(c):
        return T.identity_key(F.concat(F.lit(" "), F.regexp_extract(c, r"(\d+)", 1), F.lit("  ")))

    s = read(spark, sf_dir, "supplier").select("s_suppkey", key("s_name").alias("k"))
    c = read(spark, sf_dir, "customer").select("c_custkey", key("c_name").alias("k"))
    n = s.join(c, "k", "left").groupBy("s_suppkey").agg(F.count("c_custkey").alias("matches"))
    return n.withColumn("status", F.when(F.col("matches") == 0, "needs_exact_template").when(F.col("matches") == 1, "resolved").otherwise("error"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY nullif(l_linenumber % 3, 0) NULLS FIRST, l_suppkey, l_partkey, l_linenumber) AS place,
    'main/section[' || l_orderkey % 5 || ']' || coalesce('/table[' || nullif(l_linenumber % 3, 0) || ']/row[' || l_suppkey || ']', '') || '/paragraph[' || l_partkey || ']' AS path FROM lineitem""")
def location_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with absent parts, their order and their paths."""
    t = F.nullif(F.col("l_linenumber") % 3, F.lit(0))
    loc = location(section_ix=F.col("l_orderkey") % 5, table_ix=t, row_ix=F.when(t.isNotNull(), F.col("l_suppkey")), para_ix=F.col("l_partkey"))
    order = location(section_ix=F.col("l_orderkey") % 5, table_ix=t, row_ix=F.col("l_suppkey"), para_ix=F.col("l_partkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(order, "l_linenumber"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", place.cast("bigint").alias("place"), canonical_path(loc).alias("path"))


_PATHS = ["word/document.xml", "../evil.xml", "/abs/x", "C:\\\\x", "a/../b", "a/..b", "word\\\\..\\\\x", "", "C:x"]


@query(f"""WITH p AS (SELECT page_id, [{", ".join("'" + p.replace(chr(92) * 2, chr(92)) + "'" for p in _PATHS)}][page_id % 9 + 1] AS path, length(html) % 5000 AS expanded, page_id % 40 AS compressed FROM pages)
    SELECT page_id, path, path = '' OR regexp_matches(path, '^[/\\\\]') OR regexp_matches(path, '^[A-Za-z]:[/\\\\]') OR regexp_matches(path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AS unsafe,
        CASE WHEN expanded = 0 THEN false WHEN compressed = 0 THEN true ELSE expanded / compressed > 100 END AS ratio FROM p""")
def preflight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(p.replace("\\\\", "\\")) for p in _PATHS])
    rows = read(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 9 + 1).cast("int")).alias("path"), (F.length("html") % 5000).alias("expanded"), (F.col("page_id") % 40).alias("compressed"))
    return rows.select("page_id", "path", P.is_unsafe_path(F.col("path")).alias("unsafe"), P.exceeds_ratio(F.col("expanded"), F.col("compressed")).alias("ratio"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS closes, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem),
    c AS (SELECT *, CAST(coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS section_ix FROM s)
    SELECT l_orderkey, k, section_ix, CAST(row_number() OVER (PARTITION BY l_orderkey, section_ix ORDER BY k) - 1 AS INTEGER) AS place FROM c""")
def section_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that begin anew behind a closing row."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(by).cast("bigint"))
    return R.sections(rows, ["l_orderkey"], "k", F.col("l_returnflag") == "R").select("l_orderkey", "k", "section_ix", "place")


@query("""SELECT user_id, event_id, least(sum(CAST(floor(abs(value)) AS HUGEINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5000)::BIGINT AS total FROM events""")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals up to each row, which stop at a limit."""
    rows = read(spark, sf_dir, "events").withColumn("size", F.floor(F.abs("value")).cast("bigint"))
    return R.running_total(rows, ["user_id"], ["event_id"], "size", 5000).select("user_id", "event_id", "total")


@query("""WITH s AS (SELECT n_regionkey AS doc_id, n_nationkey AS section_ix, CASE WHEN n_nationkey % 4 > 0 THEN 1000 + n_regionkey * 10 + n_nationkey % 2 * (n_regionkey % 2) END AS w FROM nation),
    p AS (SELECT doc_id, count(DISTINCT w) AS k, count_if(w IS NULL) AS unknown, min(w) AS v FROM s GROUP BY 1)
    SELECT doc_id, 'twip:' || v AS expected, CAST(CASE WHEN unknown = 0 THEN 0.99 ELSE 0.75 END AS DOUBLE) AS confidence, unknown > 0 AS needs_confirmation FROM p WHERE k = 1""")
def template_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rules where all sections that know a value agree."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    value = F.when(n % 4 > 0, F.concat(F.lit("twip:"), (1000 + r * 10 + n % 2 * (r % 2)).cast("string")))
    rows = read(spark, sf_dir, "nation").select(r.alias("doc_id"), n.alias("section_ix"), F.lit("PageWidth").alias("property"), value.alias("value"))
    return rules.page_rules(rows)[0].select("doc_id", "expected", F.col("confidence").cast("double").alias("confidence"), "needs_confirmation")


@query(f"""WITH {MANUSCRIPT_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS position, {Q.trim("text")} AS t, lower(regexp_replace(style_id, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS token FROM manuscript),
    m AS (SELECT doc_id, pos, path, style_id, unnest([{{'on': {Q.ABSTRACT}, 't': 'Abstract', 'c': 0.99, 's': 1}}, {{'on': {Q.KEYWORDS}, 't': 'Keywords', 'c': 0.99, 's': 1}}, {{'on': {Q.heading1("t")}, 't': 'Heading1', 'c': 0.97, 's': 1}},
        {{'on': {Q.heading2("t")}, 't': 'Heading2', 'c': 0.96, 's': 1}}, {{'on': {Q.heading3("t")}, 't': 'Heading3', 'c': 0.94, 's': 1}}, {{'on': {Q.FIGURE}, 't': 'FigureCaption', 'c': 0.99, 's': 3}}, {{'on': {Q.TABLE}, 't': 'TableCaption', 'c': 0.99, 's': 3}},
        {{'on': {Q.REFERENCES}, 't': 'ReferencesHeading', 'c': 0.99, 's': 3}}, {{'on': {Q.ENTRY}, 't': 'ReferenceEntry', 'c': 0.96, 's': 3}}, {{'on': token = 'heading1', 't': 'Heading1', 'c': 0.97, 's': 2}}, {{'on': token = 'heading2', 't': 'Heading2', 'c': 0.97, 's': 2}},
        {{'on': token = 'heading3', 't': 'Heading3', 'c': 0.97, 's': 2}}]) AS e FROM x),
    h AS (SELECT doc_id, pos, path, style_id, e.t AS target, e.c AS conf, e.s AS source FROM m WHERE e.on), n AS (SELECT doc_id, target, source, style_id, count(*) AS n FROM h GROUP BY ALL),
    w AS (SELECT *, row_number() OVER o AS k, coalesce(lead(n) OVER o = n, false) AS tie FROM n WINDOW o AS (PARTITION BY doc_id, target, source ORDER BY n DESC, style_id NULLS FIRST)),
    pick AS (SELECT h.doc_id, h.target, h.source, h.path, h.conf, w.tie FROM h JOIN w ON w.k = 1 AND h.doc_id = w.doc_id AND h.target = w.target AND h.source = w.source AND h.style_id IS NOT DISTINCT FROM w.style_id
        QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.target, h.source ORDER BY h.pos) = 1),
    last AS (SELECT doc_id, target, path, conf, tie FROM pick QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY source DESC) = 1),
    chosen AS (SELECT * FROM last UNION ALL SELECT doc_id, ['Title', 'Author', 'Affiliation'][position + 1], path, [0.88, 0.85, 0.80][position + 1], false FROM x WHERE position < 3),
    rest AS (SELECT x.doc_id, x.pos, x.path, x.style_id FROM x WHERE length(text) >= 40 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.doc_id = x.doc_id AND c.path = x.path)), bn AS (SELECT doc_id, style_id, count(*) AS n FROM rest GROUP BY ALL),
    bw AS (SELECT *, row_number() OVER o AS k, coalesce(lead(n) OVER o = n, false) AS tie FROM bn WINDOW o AS (PARTITION BY doc_id ORDER BY n DESC, style_id NULLS FIRST)),
    body AS (SELECT r.doc_id, 'Body', r.path, CASE WHEN n >= 2 THEN 0.92 ELSE 0.72 END, tie OR n < 2 FROM rest r JOIN bw ON bw.k = 1 AND r.doc_id = bw.doc_id AND r.style_id IS NOT DISTINCT FROM bw.style_id QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY r.pos) = 1)
    SELECT doc_id, target, path, CAST(conf AS DOUBLE) AS confidence, tie AS needs_confirmation FROM (SELECT * FROM chosen UNION ALL SELECT * FROM body)""")
def template_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample paragraph of every target that a manuscript has, if it were a template."""
    rows = manuscript(read(spark, sf_dir, "documents"))
    sheet = rows.filter("style_id is not null").select("doc_id", "style_id").distinct().withColumn("name", F.lit(None).cast("string"))
    found = rules.template_candidates(rows, rows.limit(0), sheet)
    return found.select("doc_id", "target", "path", F.col("confidence").cast("double").alias("confidence"), "needs_confirmation")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['PageWidth', 'FontSize', 'ColumnCount', 'Bold', 'SpaceAfter'][l_partkey % 5 + 1] AS property, CASE l_partkey % 5 WHEN 0 THEN 'Page' WHEN 2 THEN 'Page' ELSE 'Body' END AS target,
    ['Safe', 'RequiresConfirmation', 'None'][l_suppkey % 3 + 1] AS repair_level, l_linenumber % 2 = 0 AS word FROM lineitem),
    a AS (SELECT *, property <> 'ColumnCount' AS able, word OR target = 'Page' AS usr FROM i),
    d AS (SELECT *, able AND CASE WHEN target = 'Page' THEN usr AND repair_level = 'RequiresConfirmation' ELSE usr AND repair_level IN ('Safe', 'RequiresConfirmation') OR repair_level = 'Safe' END AS allowed FROM a)
    SELECT allowed, CASE WHEN NOT able THEN 'SafeAutomatic' WHEN target = 'Page' OR usr AND repair_level IN ('Safe', 'RequiresConfirmation') THEN 'UserConfirmed' ELSE 'SafeAutomatic' END AS how,
        CASE WHEN allowed THEN '' WHEN NOT able THEN 'outside_allow_list' WHEN target = 'Page' THEN 'page_needs_confirmation' ELSE 'not_safe' END AS reason, count(*) AS n FROM d GROUP BY ALL""")
def repair_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who may change what, over all combinations."""
    names = F.array(*map(F.lit, ["PageWidth", "FontSize", "ColumnCount", "Bold", "SpaceAfter"]))
    k = F.col("l_partkey") % 5
    levels = F.array(*map(F.lit, ["Safe", "RequiresConfirmation", "None"]))
    own = read(spark, sf_dir, "lineitem").select(F.element_at(names, (k + 1).cast("int")).alias("property"), F.when(k.isin(0, 2), "Page").otherwise("Body").alias("target"), F.element_at(levels, (F.col("l_suppkey") % 3 + 1).cast("int")).alias("repair_level"), (F.col("l_linenumber") % 2 == 0).alias("user_confirmed"))
    made = repair.authorize_rows(own, True)
    return made.groupBy("allowed", F.col("authorization").alias("how"), "reason").agg(F.count("*").alias("n"))


_KEPT_LINES = f"""{LINES}, kept AS (SELECT doc_id, line FROM lines WHERE line <> '' UNION ALL SELECT doc_id, '-' FROM documents WHERE replace(coalesce(text, ''), chr(10), '') = '')"""


@query(f"WITH {_KEPT_LINES} SELECT doc_id, count(*) AS paragraphs, sum(length(line))::BIGINT AS chars FROM kept GROUP BY 1")
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Word packages, checked and taken apart again."""
    found = docx.table(docx.nodes(generate.packages(read(spark, sf_dir, "documents"))), "paragraph")
    return found.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {_KEPT_LINES} SELECT doc_id, 1 AS page_no, {generate.WIDTH} AS width, CAST(count(*) AS INTEGER) AS height, sum(least(length(line), {generate.WIDTH})) / CAST({generate.WIDTH} * count(*) AS DOUBLE) AS ink_ratio
    FROM kept GROUP BY 1""")
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page images, decoded to scanlines and measured."""
    seen = pages.page_evidence(png.scanlines(generate.rendered_pages(read(spark, sf_dir, "documents"))))
    return seen.select("doc_id", "page_no", "width", "height", "ink_ratio")


def _all() -> None:
    from . import catalog_parts  # noqa: F401  registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)

"""Rule packages: the built-in profile, overrides, derivation from templates.

A rule row: package_id, revision, rule_id, target, property, expected (a value key), severity, repair_level, confidence,
enabled, needs_confirmation, evidence. Value keys are kind:value texts (twip:240, int:2, bool:True, text:Body,
orientation:Portrait, alignment:Left, spacing:Auto::240), so equality of values is equality of keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import predicates as P
from folioscan.functions.text import digest_id, style_token

from .relational import modal_sample

#: Targets, element kinds, severities and repair levels, in the orders that sorts follow.
TARGETS = ["Page", "Title", "Author", "Affiliation", "Abstract", "Keywords", "Heading1", "Heading2", "Heading3", "Body", "FigureCaption", "TableCaption", "TableText", "ReferencesHeading", "ReferenceEntry"]
SEVERITIES = ["Error", "Warning", "Information"]
PROFILE = "ieee-like-v1"
SCHEMA = "package_id string, revision int, rule_id string, target string, property string, expected string, severity string, repair_level string, confidence decimal(3,2), enabled boolean, needs_confirmation boolean, evidence string"
#: Expected page settings of the profile.
PAGE = {
    "PageWidth": "twip:12240", "PageHeight": "twip:15840", "PageOrientation": "orientation:Portrait", "MarginTop": "twip:1080", "MarginRight": "twip:720",
    "MarginBottom": "twip:1080", "MarginLeft": "twip:720", "ColumnCount": "int:2", "ColumnSpacing": "twip:360",
}
#: Style, size in points, alignment, bold, italic, space before and after in twips, for each text target.
TEXT = {
    "Title": ("PaperTitle", 24, "Center", False, False, 0, 120),
    "Author": ("Authors", 11, "Center", False, False, 0, 60),
    "Affiliation": ("Affiliation", 9, "Center", False, True, 0, 120),
    "Abstract": ("AbstractText", 9, "Justified", False, False, 0, 60),
    "Keywords": ("Keywords", 9, "Justified", False, False, 0, 120),
    "Heading1": ("Heading1", 10, "Center", True, False, 120, 60),
    "Heading2": ("Heading2", 10, "Left", False, True, 120, 40),
    "Heading3": ("Heading3", 10, "Left", False, True, 80, 40),
    "Body": ("BodyText", 10, "Justified", False, False, 0, 0),
    "FigureCaption": ("Caption", 8, "Center", False, False, 40, 80),
    "TableCaption": ("Caption", 8, "Center", False, False, 40, 80),
    "TableText": ("TableText", 8, "Left", None, None, 0, 0),
    "ReferencesHeading": ("Heading1", 10, "Center", True, False, 120, 60),
    "ReferenceEntry": ("BodyText", 8, "Justified", False, False, 0, 0),
}
#: Style markers that name heading levels.
HEADING_MARKERS = {
    "Heading1": ["heading1", "sectionheading", "sectiontitle", "level1heading", "head1"],
    "Heading2": ["heading2", "subsectionheading", "subsectiontitle", "level2heading", "head2"],
    "Heading3": ["heading3", "subsubsectionheading", "subsubsectiontitle", "level3heading", "head3"],
}


def slug(name: str) -> str:
    """PageWidth -> page-width, Heading1 -> heading-1"""
    return "".join(f"-{c.lower()}" if c.isupper() or c.isdigit() else c for c in name).lstrip("-")


def slug_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?<=.)([A-Z0-9])", r"-$1"))


def _text_values(target: str) -> dict[str, str]:
    style, points, align, bold, italic, before, after = TEXT[target]
    out = {"ParagraphStyleId": f"text:{style}", **{p: "text:Times New Roman" for p in P.FONT_PROPERTIES}, "FontSize": f"twip:{points * 20}"}
    if bold is not None:
        out |= {"Bold": f"bool:{bold}", "Italic": f"bool:{italic}"}
    return out | {"ParagraphAlignment": f"alignment:{align}", "LineSpacing": "spacing:Auto::240", "SpaceBefore": f"twip:{before}", "SpaceAfter": f"twip:{after}"}


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The built-in profile's rules, as rows that the optimizer sees: what a filter of them leaves empty is not planned."""
    rows = [("Page", p, v, "Error", "None" if p.startswith("Column") else "RequiresConfirmation") for p, v in PAGE.items()]
    for target in TEXT:
        rows += [(target, p, v, "Warning", "None" if p == "ParagraphStyleId" else "Safe") for p, v in _text_values(target).items()]
    rows.append(("Body", "FirstLineIndent", "twip:289", "Warning", "Safe"))
    rows.append(("Body", "DirectFormattingConsistency", "bool:True", "Warning", "None"))
    rows += [(t, "CaptionNumberSequence", "bool:True", "Warning", "None") for t in ("FigureCaption", "TableCaption")]
    made = [(PROFILE, 1, f"{PROFILE}.{slug(t)}.{slug(p)}", t, p, v, s, r, 1, True, False, f"profile:{PROFILE}") for t, p, v, s, r in rows]
    fields = [f.split() for f in SCHEMA.split(", ")]
    table = pa.table({name: list(values) for (name, _), values in zip(fields, zip(*made, strict=True), strict=True)})
    return spark.createDataFrame(table).select(*[F.col(name).cast(kind) for name, kind in fields])


def ordinal(c: Column, names: list[str]) -> Column:
    """Place of a name in its fixed order, by which it sorts."""
    return F.array_position(F.array(*map(F.lit, names)), c).cast("int")


def expected_kind(prop: Column) -> Column:
    """The kind of value that a property takes."""
    return (
        F.when(prop.isin(P.FONT_PROPERTIES) | (prop == "ParagraphStyleId"), "text")
        .when(prop.isin("Bold", "Italic", "CaptionNumberSequence", "DirectFormattingConsistency"), "bool")
        .when(prop == "PageOrientation", "orientation")
        .when(prop == "ParagraphAlignment", "alignment")
        .when(prop == "LineSpacing", "spacing")
        .when(prop == "ColumnCount", "int")
        .otherwise("twip")
    )


def rule_errors(rules: DataFrame) -> DataFrame:
    """(rule_id, error): ids that repeat in a package, values of another kind than the property's, confidences outside 0..1,
    unknown targets."""
    twice = rules.groupBy("package_id", "rule_id").count().filter("count > 1").select("rule_id", F.lit("duplicate_rule_id").alias("error"))
    typed = rules.filter(F.split_part("expected", F.lit(":"), F.lit(1)) != expected_kind(F.col("property"))).select("rule_id", F.lit("value_kind").alias("error"))
    range_ = rules.filter("confidence < 0 or confidence > 1").select("rule_id", F.lit("confidence").alias("error"))
    unknown = rules.filter(~F.col("target").isin(TARGETS)).select("rule_id", F.lit("target").alias("error"))
    return twice.union(typed).union(range_).union(unknown)


def override_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """rules under edits (rule_id, expected, enabled; null keeps): the next revision, edited rules with user evidence.
    Edits of unknown rules and repeated edits are errors when the result is read."""
    many = edits.groupBy("rule_id").agg(F.first("expected", True).alias("_e"), F.first("enabled", True).alias("_on"), F.count("*").alias("_n"))
    both = rules.join(many, "rule_id", "full_outer")
    problem = F.when(F.col("_n") > 1, F.concat(F.lit("repeated edit of "), "rule_id")).when(F.col("target").isNull(), F.concat(F.lit("edit of unknown rule "), "rule_id"))
    both = both.withColumn("rule_id", F.when(problem.isNull(), F.col("rule_id")).otherwise(F.raise_error(problem).cast("string")))
    return both.select(
        "package_id", (F.col("revision") + 1).alias("revision"), "rule_id", "target", "property", F.coalesce("_e", "expected").alias("expected"), "severity", "repair_level", "confidence",
        F.coalesce("_on", "enabled").alias("enabled"), (F.col("needs_confirmation") & F.col("_e").isNull()).alias("needs_confirmation"), F.when(F.col("_n") > 0, "user-override").otherwise(F.col("evidence")).alias("evidence"),
    )


def page_rules(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and notices from page values (doc_id, section_ix, property, value key or null): a property has a rule when all
    sections that know it agree; surer when all know it."""
    per = sections.groupBy("doc_id", "property").agg(F.count_distinct("value").alias("k"), F.count_if(F.col("value").isNull()).alias("unknown"), F.min("value").alias("expected"))
    notices = per.filter("k <> 1").select("doc_id", F.concat(F.lit("template.page."), slug_column(F.col("property")), F.when(F.col("k") == 0, ".missing").otherwise(".ambiguous")).alias("code"))
    sure = F.col("unknown") == 0
    rules = per.filter("k = 1").select(
        "doc_id", F.concat(F.lit("template-v1.page."), slug_column(F.col("property"))).alias("rule_id"), F.lit("Page").alias("target"), "property", "expected", F.lit("Error").alias("severity"),
        F.when(F.col("property").startswith("Column"), "None").otherwise("RequiresConfirmation").alias("repair_level"), F.when(sure, 0.99).otherwise(0.75).cast("decimal(3,2)").alias("confidence"), (~sure).alias("needs_confirmation"),
    )
    return rules, notices


def template_candidates(paragraphs: DataFrame, table_paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """For each document and target the sample paragraph: (doc_id, target, path, style_id, confidence, needs_confirmation).
    paragraphs and table_paragraphs: doc_id, loc, path, text, style_id; styles: doc_id, style_id, name.

    Later sources override earlier ones: place, text pattern, heading style; then captions, references, entries; the body
    is what no other target took, 40 characters or more; table text comes from cells."""
    text = F.col("text")
    rows = paragraphs.filter("length(text) > 0").withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("loc")) - 1)
    names = styles.select("doc_id", "style_id", style_token(F.col("style_id")).alias("_id"), style_token(F.coalesce("name", F.lit(""))).alias("_name"))
    rows = rows.join(names, ["doc_id", "style_id"], "left")
    marks = [
        (P.is_abstract(text), "Abstract", 0.99, 1), (P.is_keywords(text), "Keywords", 0.99, 1), (P.is_heading1(text), "Heading1", 0.97, 1), (P.is_heading2(text), "Heading2", 0.96, 1), (P.is_heading3(text), "Heading3", 0.94, 1),
        (P.is_figure_caption(text), "FigureCaption", 0.99, 3), (P.is_table_caption(text), "TableCaption", 0.99, 3), (P.is_references_heading(text), "ReferencesHeading", 0.99, 3), (P.is_reference_entry(text), "ReferenceEntry", 0.96, 3),
    ]
    marks += [(P.sure(F.col("_id").isin(m) | F.col("_name").isin(m)), t, 0.97, 2) for t, m in HEADING_MARKERS.items()]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(t).alias("target"), F.lit(k).cast("decimal(3,2)").alias("confidence"), F.lit(s).alias("source"))) for c, t, k, s in marks]), lambda x: x.isNotNull())
    matched = rows.select("doc_id", "loc", "path", "style_id", F.explode(hits).alias("m")).select("*", "m.*").drop("m")
    samples = modal_sample(matched, ["doc_id", "target", "source"], "style_id", "loc")
    last = Window.partitionBy("doc_id", "target").orderBy(F.desc("source"))
    samples = samples.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("doc_id", "target", "loc", "path", "style_id", "confidence", F.col("tie").alias("needs_confirmation"))
    places = {0: ("Title", 0.88), 1: ("Author", 0.85), 2: ("Affiliation", 0.80)}
    pick = F.element_at(F.create_map(*[x for k, (t, _) in places.items() for x in (F.lit(k), F.lit(t))]), F.col("position").cast("int"))
    sure = F.element_at(F.create_map(*[x for k, (_, c) in places.items() for x in (F.lit(k), F.lit(c).cast("decimal(3,2)"))]), F.col("position").cast("int"))
    first = rows.filter("position < 3").select("doc_id", pick.alias("target"), "loc", "path", "style_id", sure.alias("confidence"), F.lit(False).alias("needs_confirmation"))
    chosen = samples.union(first)
    body = rows.join(chosen.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti").filter("length(text) >= 40")
    body = modal_sample(body.select("doc_id", "loc", "path", "style_id"), ["doc_id"], "style_id", "loc")
    many = F.col("n_modal") >= 2
    body = body.select("doc_id", F.lit("Body").alias("target"), "loc", "path", "style_id", F.when(many, 0.92).otherwise(0.72).cast("decimal(3,2)").alias("confidence"), (F.col("tie") | ~many).alias("needs_confirmation"))
    cells = modal_sample(table_paragraphs.filter("length(text) > 0").select("doc_id", "loc", "path", "style_id"), ["doc_id"], "style_id", "loc")
    cells = cells.select("doc_id", F.lit("TableText").alias("target"), "loc", "path", "style_id", F.lit(0.96).cast("decimal(3,2)").alias("confidence"), F.col("tie").alias("needs_confirmation"))
    return chosen.union(body).union(cells)


def missing_targets(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, code) of targets without a sample."""
    wanted = documents.select("doc_id").distinct().withColumn("target", F.explode(F.array(*map(F.lit, TARGETS[1:]))))
    return wanted.join(candidates, ["doc_id", "target"], "left_anti").select("doc_id", F.concat(F.lit("template."), slug_column(F.col("target")), F.lit(".missing")).alias("code"))


def sample_formatting(candidates: DataFrame, runs: DataFrame, styles: DataFrame) -> DataFrame:
    """candidates with chr: the resolved character formatting of the sample's style, or what all its text runs agree on.
    runs: doc_id, para_path, text, effective; styles: doc_id, style_id, chr (resolved)."""
    fields = ["font_ascii", "font_hansi", "font_ea", "font_cs", "size_tw", "bold", "italic"]
    agreed = [F.when(F.count_distinct(F.col("effective")[f]) == 1, F.min(F.col("effective")[f])).alias(f) for f in fields]
    uniform = runs.filter("length(text) > 0").groupBy("doc_id", F.col("para_path").alias("path")).agg(*agreed)
    uniform = uniform.select("doc_id", "path", F.struct(*fields).alias("_u"))
    own = styles.select("doc_id", "style_id", F.struct(*[F.col("chr")[f].alias(f) for f in fields]).alias("_s"))
    rows = candidates.join(own, ["doc_id", "style_id"], "left").join(uniform, ["doc_id", "path"], "left")
    return rows.withColumn("chr", F.coalesce("_s", "_u")).drop("_s", "_u")


def emitted_rules(samples: DataFrame) -> DataFrame:
    """One rule for each known property of a sample (doc_id, target, chr, para, confidence, needs_confirmation); table text
    gives fonts and size only."""
    p, c = F.col("para"), F.col("chr")
    cell = F.col("target") == "TableText"

    def twip(x: Column) -> Column:
        return F.concat(F.lit("twip:"), x.cast("string"))

    def text(x: Column) -> Column:
        return F.when(F.trim(x) != "", F.concat(F.lit("text:"), x))

    def flag(x: Column) -> Column:
        return F.when(x, "bool:True").when(~x, "bool:False")

    spacing = F.when(p["spacing_kind"] == "Auto", F.concat(F.lit("spacing:Auto::"), p["spacing_value"].cast("string"))).when(p["spacing_kind"].isNotNull(), F.concat(F.lit("spacing:"), p["spacing_kind"], F.lit(":"), p["spacing_value"].cast("string"), F.lit(":")))
    values = {
        "ParagraphAlignment": F.when(~cell, F.concat(F.lit("alignment:"), p["align"])), "LineSpacing": F.when(~cell, spacing), "SpaceBefore": F.when(~cell, twip(p["before_tw"])), "SpaceAfter": F.when(~cell, twip(p["after_tw"])),
        "FirstLineIndent": F.when(~cell, twip(p["first_line_tw"])), "FontAscii": text(c["font_ascii"]), "FontHighAnsi": text(c["font_hansi"]), "FontEastAsia": text(c["font_ea"]), "FontComplexScript": text(c["font_cs"]),
        "FontSize": twip(c["size_tw"]), "Bold": F.when(~cell, flag(c["bold"])), "Italic": F.when(~cell, flag(c["italic"])),
    }
    long = samples.select("doc_id", "target", "confidence", "needs_confirmation", F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("expected")) for k, v in values.items()])).alias("v"))
    long = long.select("doc_id", "target", "v.property", "v.expected", "confidence", "needs_confirmation").filter("expected is not null")
    rule_id = F.concat(F.lit("template-v1."), slug_column(F.col("target")), F.lit("."), slug_column(F.col("property")))
    return long.select("doc_id", rule_id.alias("rule_id"), "target", "property", "expected", F.lit("Warning").alias("severity"), F.lit("Safe").alias("repair_level"), "confidence", "needs_confirmation")


def template_package_id(name: Column, kind: Column, sections: Column, style_ids: Column) -> Column:
    """style_ids: an array in document order."""
    return digest_id("template-v1-", 16, F.concat_ws("|", name, kind, sections.cast("string"), F.array_join(style_ids, ",")))

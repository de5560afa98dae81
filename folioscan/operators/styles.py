"""Style sheets: first definitions, inheritance with cycles, effective formatting, numbering.

Style tables are per document: (doc_id, style_id, ord, name, kind, based_on, linked, is_default, para, chr, tbl), where
para, chr and tbl are structs of nullable fields; null means not specified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import layered, overlay, shuffled

PARA = ["align", "spacing_kind", "spacing_value", "before_tw", "after_tw", "left_tw", "right_tw", "first_line_tw", "hanging_tw", "keep_next", "keep_lines", "page_break", "widow"]
CHR = ["font_ascii", "font_hansi", "font_ea", "font_cs", "size_tw", "bold", "italic", "caps", "small_caps"]
TBL = ["width_tw", "align", "autofit"]
DEPTH = 64


def struct_type(fields: list[str]) -> str:
    kinds = {"align": "string", "spacing_kind": "string", **dict.fromkeys(["keep_next", "keep_lines", "page_break", "widow", "bold", "italic", "caps", "small_caps", "autofit"], "boolean")}
    return "struct<" + ",".join(f"{f}:{kinds.get(f, 'string' if f.startswith('font') else 'bigint')}" for f in fields) + ">"


def first_definitions(styles: DataFrame) -> DataFrame:
    """Styles with an id; of equal ids the first in document order."""
    rows = styles.filter(F.trim(F.coalesce("style_id", F.lit(""))) != "")
    by = Window.partitionBy("doc_id", "style_id").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def style_diagnostics(styles: DataFrame) -> DataFrame:
    """(doc_id, code): missing and duplicate ids, base and linked styles that don't exist, cycles; each code once."""
    blank = F.trim(F.coalesce("style_id", F.lit(""))) == ""
    known = first_definitions(styles)
    ids = shuffled(known.select("doc_id", F.col("style_id").alias("other")))
    found = styles.filter(blank).select("doc_id", F.lit("missing_style_id").alias("code"))
    found = found.union(styles.filter(~blank).groupBy("doc_id", "style_id").count().filter("count > 1").select("doc_id", F.lit("duplicate_style_id")))
    for column, code in (("based_on", "missing_base_style"), ("linked", "missing_linked_style")):
        asked = known.filter(F.col(column).isNotNull()).select("doc_id", F.col(column).alias("other"))
        found = found.union(asked.join(ids, ["doc_id", "other"], "left_anti").select("doc_id", F.lit(code)))
    found = found.union(cycles(known).select("doc_id", F.lit("style_inheritance_cycle")))
    return found.distinct()


def undefined_references(used: DataFrame, styles: DataFrame) -> DataFrame:
    """(doc_id, style_id) that elements use and no style defines."""
    return used.filter("style_id is not null").select("doc_id", "style_id").distinct().join(shuffled(first_definitions(styles)), ["doc_id", "style_id"], "left_anti")


def _chains(styles: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, style_id, chain, ring): the styles from each upwards along based_on, each once, as structs of style_id, ring and
    the kept columns; ring: whether the style is a member of a cycle. A style sheet is one row meanwhile, so nothing is joined.
    Every round doubles the reach of all chains, so a chain of depth d takes log2(d) rounds."""
    sheets = styles.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("style_id", "based_on", *kept)).alias("s"))
    # places in the sheet from 1 on; up: that of the base, 0 without one
    up = F.transform(F.col("s"), lambda x: F.when(F.coalesce(x["based_on"], F.lit("")) == "", 0).otherwise(F.array_position(F.col("s")["style_id"], x["based_on"]).cast("int")))
    start = F.struct(up.alias("up"), F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.array(i)).alias("paths"))

    def base(acc: Column, path: Column) -> Column:
        return F.element_at(acc["up"], F.element_at(path, -1))

    def double(acc: Column, _: Column) -> Column:
        longer = F.transform(acc["paths"], lambda p: F.when(base(acc, p) > 0, F.array_distinct(F.concat(p, F.element_at(acc["paths"], F.greatest(base(acc, p), F.lit(1)))))).otherwise(p))
        return F.struct(acc["up"].alias("up"), longer.alias("paths"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("s"))).cast("int"))
    made = F.aggregate(rounds, start, double, lambda acc: F.transform(acc["paths"], lambda p: F.struct(p.alias("path"), (base(acc, p) == p[0]).alias("ring"))))
    rings = F.transform(F.arrays_zip("s", "made"), lambda x: x["s"].withField("ring", x["made"]["ring"]))
    sheets = sheets.withColumn("made", made).select("doc_id", "made", rings.alias("s"))
    listed = F.transform("made", lambda m: F.transform(m["path"], lambda i: F.element_at("s", i).dropFields("based_on")))
    return sheets.select("doc_id", F.explode(listed).alias("chain")).select("doc_id", F.col("chain")[0]["style_id"].alias("style_id"), "chain", F.col("chain")[0]["ring"].alias("ring"))


def ancestors(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, ancestor, depth) along based_on, depth 0 the style itself. Chains are as deep as a style sheet is."""
    return _chains(styles).select("doc_id", "style_id", F.posexplode(F.col("chain")["style_id"]).alias("depth", "ancestor"))


def cycles(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id) of the members of inheritance cycles: those that are an ancestor of their own base."""
    return _chains(styles).filter("ring").select("doc_id", "style_id")


def contributions(styles: DataFrame) -> DataFrame:
    """doc_id, style_id and the formatting that a style gives: its own over its base's, and so on. Members of a cycle keep
    their own only; styles based on a member get that member's."""
    rows = _chains(first_definitions(styles), "para", "chr", "tbl")
    member = F.array_position(F.col("chain")["ring"], True).cast("int")
    rows = rows.withColumn("chain", F.when(member > 0, F.slice("chain", 1, F.greatest(member, F.lit(1)))).otherwise(F.col("chain")))

    def nearest(kind: str, fields: list[str]) -> Column:
        return F.struct(*[F.get(F.array_compact(F.col("chain")[kind][f]), F.lit(0)).alias(f) for f in fields]).alias(kind)

    return rows.select("doc_id", "style_id", nearest("para", PARA), nearest("chr", CHR), nearest("tbl", TBL))


def default_styles(styles: DataFrame) -> DataFrame:
    """doc_id and the first default style of each kind: default_paragraph, default_character, default_table."""
    rows = styles.filter("is_default")
    pick = [F.min_by(F.when(F.col("kind") == k, F.col("style_id")), F.when(F.col("kind") == k, F.col("ord"))).alias(f"default_{k}") for k in ("paragraph", "character", "table")]
    return rows.groupBy("doc_id").agg(*pick)


def effective_paragraphs(paragraphs: DataFrame, styles: DataFrame, defaults: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """paragraphs (doc_id, style_id, table_style_id, direct, ...) with effective: document defaults, table style, paragraph
    style, direct formatting. defaults: (doc_id, para, chr); given: contributions(styles), if they are at hand."""
    bags = (contributions(styles) if given is None else given).select("doc_id", "style_id", "para")
    rows = paragraphs.join(shuffled(default_styles(styles)), "doc_id", "left").join(shuffled(defaults.select("doc_id", F.col("para").alias("_base"))), "doc_id", "left")
    rows = rows.withColumn("_t", F.coalesce("table_style_id", "default_table")).withColumn("_p", F.coalesce("style_id", "default_paragraph"))
    for key, out in (("_t", "_tp"), ("_p", "_pp")):
        rows = rows.join(shuffled(bags.select("doc_id", F.col("style_id").alias(key), F.col("para").alias(out))), ["doc_id", key], "left")
    made = layered([F.col(c) for c in ("_base", "_tp", "_pp", "direct")], PARA)
    return rows.withColumn("effective", made).drop("_base", "_t", "_p", "_tp", "_pp", "default_paragraph", "default_character", "default_table")


def effective_runs(runs: DataFrame, styles: DataFrame, defaults: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """runs (doc_id, style_id of the paragraph, table_style_id, mark, run_style_id, direct, ...) with effective, of eight
    layers: document defaults, default character style, table style, the style linked to the paragraph's, the
    paragraph's, its mark, the run's style, direct formatting."""
    styles = first_definitions(styles)
    bags = (contributions(styles) if given is None else given).select("doc_id", "style_id", "chr")
    rows = runs.join(shuffled(default_styles(styles)), "doc_id", "left").join(shuffled(defaults.select("doc_id", F.col("chr").alias("_l0"))), "doc_id", "left")
    rows = rows.withColumn("_t", F.coalesce("table_style_id", "default_table")).withColumn("_p", F.coalesce("style_id", "default_paragraph"))
    rows = rows.join(shuffled(styles.select("doc_id", F.col("style_id").alias("_p"), F.col("linked").alias("_k"))), ["doc_id", "_p"], "left")
    layers = [("default_character", "_l1"), ("_t", "_l2"), ("_k", "_l3"), ("_p", "_l4"), ("run_style_id", "_l6")]
    for key, out in layers:
        rows = rows.join(shuffled(bags.select("doc_id", F.col("style_id").alias(key), F.col("chr").alias(out))), ["doc_id", key], "left")
    made = layered([F.col(c) for c in ("_l0", "_l1", "_l2", "_l3", "_l4", "mark", "_l6", "direct")], CHR)
    return rows.withColumn("effective", made).drop("_t", "_p", "_k", "default_paragraph", "default_character", "default_table", *[f"_l{i}" for i in (0, 1, 2, 3, 4, 6)])


def effective_tables(tables: DataFrame, styles: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """tables (doc_id, style_id, direct, ...) with effective: table style, direct formatting."""
    bags = (contributions(styles) if given is None else given).select("doc_id", "style_id", F.col("tbl").alias("_b"))
    rows = tables.join(shuffled(default_styles(styles)), "doc_id", "left").withColumn("_s", F.coalesce("style_id", "default_table"))
    rows = rows.join(shuffled(bags.withColumnRenamed("style_id", "_s")), ["doc_id", "_s"], "left")
    return rows.withColumn("effective", overlay(F.col("_b"), F.col("direct"), TBL)).drop("_b", "_s", "default_paragraph", "default_character", "default_table")


def numbering(styles: DataFrame) -> DataFrame:
    """(doc_id, style_id, num_id, level): of the nearest style, from the style itself upwards, that has a number."""
    up = ancestors(styles.select("doc_id", "style_id", "based_on"))
    own = styles.filter(F.coalesce("num_id", F.lit("")) != "").select("doc_id", F.col("style_id").alias("ancestor"), "num_id", "level")
    near = up.join(own, ["doc_id", "ancestor"]).groupBy("doc_id", "style_id").agg(F.min_by(F.struct("num_id", "level"), "depth").alias("n"))
    return near.select("doc_id", "style_id", "n.num_id", "n.level")

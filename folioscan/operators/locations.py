"""Structural locations: a struct that sorts as locations do (nulls first), and its canonical path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a package, in their order.
PARTS = ["main", "header", "footer", "footnote", "endnote", "comment"]
INDEXES = ["part_ix", "section_ix", "table_ix", "row_ix", "cell_ix", "para_ix", "run_ix"]
_NAMES = {"section_ix": "section", "table_ix": "table", "row_ix": "row", "cell_ix": "cell", "para_ix": "paragraph", "run_ix": "run"}


def location(part: Column | None = None, rel: Column | None = None, **indexes: Column) -> Column:
    """The struct; absent indexes are null. Its fields stand in sort order."""
    part = F.lit("main") if part is None else part
    order = F.array_position(F.array(*map(F.lit, PARTS)), part).cast("int")
    fields = [(indexes[i] if i in indexes else F.lit(None)).cast("int").alias(i) for i in INDEXES]
    return F.struct(order.alias("part_order"), *fields, (F.lit(None) if rel is None else rel).cast("string").alias("rel"))


def canonical_path(loc: Column) -> Column:
    def bracket(c: Column) -> Column:
        return F.concat(F.lit("["), c.cast("string"), F.lit("]"))

    part = F.element_at(F.array(*map(F.lit, PARTS)), loc["part_order"])
    head = F.concat(part, F.coalesce(bracket(loc["part_ix"]), F.lit("")))
    segments = [F.concat(F.lit(name), bracket(loc[i])) for i, name in _NAMES.items()]
    relation = F.concat(F.lit("relationship["), F.replace(F.url_encode(loc["rel"]), F.lit("+"), F.lit("%20")), F.lit("]"))
    return F.concat_ws("/", head, *segments, relation)


def element_id(loc: Column) -> Column:
    return F.concat(F.lit("element:"), canonical_path(loc))


def parse_element_id(c: Column) -> Column:
    """(section_ix, para_ix) of a body paragraph's element id; an error for others."""
    pattern = r"^element:main/section\[(\d+)\]/paragraph\[(\d+)\]$"
    found = F.struct(F.regexp_extract(c, pattern, 1).cast("int").alias("section_ix"), F.regexp_extract(c, pattern, 2).cast("int").alias("para_ix"))
    return F.when(c.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("not a body paragraph: "), c)).cast("struct<section_ix:int,para_ix:int>"))


def invalid_location(loc: Column) -> Column:
    """What breaks a location's rules, or null."""
    negative = F.lit(False)
    for i in INDEXES:
        negative = negative | F.coalesce(loc[i] < 0, F.lit(False))
    return (
        F.when(negative, "negative_index")
        .when(loc["row_ix"].isNotNull() & loc["table_ix"].isNull(), "row_without_table")
        .when(loc["cell_ix"].isNotNull() & loc["row_ix"].isNull(), "cell_without_row")
        .when(loc["run_ix"].isNotNull() & loc["para_ix"].isNull(), "run_without_paragraph")
        .when((loc["part_order"] == 1) & loc["part_ix"].isNotNull(), "main_part_with_index")
        .when(F.trim(loc["rel"]) == "", "blank_relationship")
    )


def find(elements: DataFrame, paths: DataFrame, kind: str | None = None) -> DataFrame:
    """Elements (doc_id, path, ...) at given (doc_id, path), of one kind if asked."""
    found = elements.join(paths.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi")
    return found if kind is None else found.filter(F.col("kind") == kind)


def body_and_table_paragraphs(body: DataFrame, cells: DataFrame) -> DataFrame:
    """Both kinds of paragraphs as one index by (doc_id, path); a path that occurs twice is an error when it is read."""
    both = body.unionByName(cells, allowMissingColumns=True).withColumn("path", canonical_path(F.col("loc")))
    twice = both.groupBy("doc_id", "path").agg(F.count("*").alias("n")).filter("n > 1")
    both = both.join(twice, ["doc_id", "path"], "left")
    return both.withColumn("path", F.when(F.col("n").isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("duplicate path: "), "path")).cast("string"))).drop("n")

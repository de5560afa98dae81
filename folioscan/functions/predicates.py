"""Boolean columns. A null input is false unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim, trim_left

#: The properties of rules, by what they are properties of, in the order that sorts follow.
PAGE_PROPERTIES = ["PageWidth", "PageHeight", "PageOrientation", "MarginTop", "MarginRight", "MarginBottom", "MarginLeft", "ColumnCount", "ColumnSpacing"]
FONT_PROPERTIES = ["FontAscii", "FontHighAnsi", "FontEastAsia", "FontComplexScript"]
CHARACTER_PROPERTIES = [*FONT_PROPERTIES, "FontSize", "Bold", "Italic"]
PARAGRAPH_PROPERTIES = ["ParagraphStyleId", "ParagraphAlignment", "LineSpacing", "SpaceBefore", "SpaceAfter", "FirstLineIndent", "DirectFormattingConsistency"]
REPAIRABLE = [*PAGE_PROPERTIES[:7], *CHARACTER_PROPERTIES, *PARAGRAPH_PROPERTIES[:6]]
LAYOUT_AFFECTING = [*PAGE_PROPERTIES[:7], "ParagraphStyleId"]
ROLLBACKS = ["discardCandidateCopy", "restoreSectionSnapshot", "preserveOriginalPackage"]
CONFIRMED = ["Confirmed", "UserConfirmed"]


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_confirmed(status: Column) -> Column:
    return sure(status.isin(CONFIRMED))


def is_page_property(c: Column) -> Column:
    return sure(c.isin(PAGE_PROPERTIES))


def is_character_property(c: Column) -> Column:
    return sure(c.isin(CHARACTER_PROPERTIES))


def is_paragraph_property(c: Column) -> Column:
    return sure(c.isin(PARAGRAPH_PROPERTIES))


def is_repairable(c: Column) -> Column:
    return sure(c.isin(REPAIRABLE))


def is_layout_affecting(c: Column) -> Column:
    return sure(c.isin(LAYOUT_AFFECTING))


def is_rollback(c: Column) -> Column:
    return sure(c.isin(ROLLBACKS))


def _starts(c: Column, *prefixes: str) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return sure(out)


def is_abstract(text: Column) -> Column:
    return _starts(trim(text), "abstract", "摘要")


def is_keywords(text: Column) -> Column:
    return _starts(trim(text), "index terms", "keywords", "关键词")


def is_figure_caption(text: Column) -> Column:
    return _starts(trim_left(text), "fig.", "figure", "图")


def is_table_caption(text: Column) -> Column:
    return _starts(trim_left(text), "table", "表")


def is_references_heading(text: Column) -> Column:
    return sure(F.lower(trim(text)).isin("references", "参考文献"))


def is_reference_entry(text: Column) -> Column:
    return sure(trim_left(text).rlike(r"(?s)^\[\p{Nd}.*\]"))


def is_heading1(text: Column) -> Column:
    return sure(trim(text).rlike(r"(?is)^[IVXLCDM]{1,7}\..*\p{L}"))


def is_heading2(text: Column) -> Column:
    return sure(trim(text).rlike(r"(?Us)^\p{L}\.\s."))


def is_heading3(text: Column) -> Column:
    return sure(trim(text).rlike(r"(?s)^\p{Nd}{1,3}\)."))


def is_heading(text: Column) -> Column:
    return is_heading1(text) | is_heading2(text) | is_heading3(text)


def is_unsafe_path(path: Column) -> Column:
    """An archive entry that could leave its folder: empty, rooted, with a drive, or with a parent segment."""
    return F.coalesce((path == "") | path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:[/\\]") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), F.lit(True))


def exceeds_ratio(expanded: Column, compressed: Column, most: float = 100.0) -> Column:
    """Expands more than allowed; content out of nothing always does."""
    return sure(F.when(expanded == 0, False).when(compressed == 0, True).otherwise(expanded / compressed > most))


def has_zip_signature(content: Column) -> Column:
    return sure(F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708"))


def is_word_package(path: Column) -> Column:
    return sure(F.lower(path).rlike(r"\.(docx|dotx)$"))


def values_equal(prop: Column, current: Column, expected: Column) -> Column:
    """Of value keys: fonts compare without case, all else exactly; an unknown value equals nothing."""
    return sure(F.when(prop.isin(FONT_PROPERTIES), F.lower(current) == F.lower(expected)).otherwise(current == expected))

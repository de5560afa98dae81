"""Scalars over text: captions, numerals, identifiers, encodings. Lengths are code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The seven Roman letters.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
SPACE = r"(?U)\s+"


def camel(name: str) -> str:
    """issue_id -> issueId"""
    head, *rest = name.split("_")
    return head + "".join(r.capitalize() for r in rest)


def _normal_form(form: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return normal


nfc, nfkc = _normal_form("NFC"), _normal_form("NFKC")


@F.pandas_udf(T.StringType())
def venue_key(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, case folding, and the a-z0-9 tokens that are left."""
    folded = s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).casefold(), na_action="ignore")
    return folded.str.findall(r"[a-z0-9]+").str.join(" ")


@F.pandas_udf(T.StringType())
def identity_key(s: pd.Series) -> pd.Series:
    """Compatibility composition, case folding, single spaces."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


#: The characters that are white space.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(BLANKS))


def trim_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def normal_space(c: Column) -> Column:
    """Composed form, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(nfc(c), SPACE, " "))


def style_token(c: Column) -> Column:
    """Letters and digits, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def decimal_prefix(c: Column) -> Column:
    """The leading digits as a 32-bit number, or null."""
    return F.regexp_extract(c, r"^(\p{Nd}+)", 1).try_cast("int")


def roman_number(c: Column) -> Column:
    """Value of Roman letters in any order: from the right, a letter below its right neighbour is taken off. Null for other
    letters, empty text and a sum that is not positive."""
    value = F.lit(0)
    upper = F.upper(c)
    letters = F.reverse(F.filter(F.split(upper, ""), lambda x: x != ""))

    def worth(x: Column) -> Column:
        out = F.lit(0)
        for letter, n in ROMAN.items():
            out = F.when(x == letter, n).otherwise(out)
        return out

    start = F.struct(value.alias("total"), value.alias("before"))
    walked = F.aggregate(letters, start, lambda a, x: F.struct((a["total"] + F.when(worth(x) < a["before"], -worth(x)).otherwise(worth(x))).alias("total"), worth(x).alias("before")))
    return F.when(c.rlike("(?i)^[IVXLCDM]+$") & (walked["total"] > 0), walked["total"])


def caption_number(text: Column, target: Column) -> Column:
    """Figure captions: the first digits. Table captions: the token after the first space, decimal or else Roman."""
    left = trim_left(text)
    figure = F.regexp_extract(left, r"(\p{Nd}+)", 1).try_cast("int")
    token = F.regexp_extract(left, r"(?sU)^[^ ]* \s*([\p{L}\p{Nd}]*)", 1)
    return F.when(target == "FigureCaption", figure).when(target == "TableCaption", F.coalesce(decimal_prefix(token), roman_number(token)))


def encode_sequence(values: Column) -> Column:
    """An array as length:value; pieces: unambiguous whatever the values hold."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v, F.lit(";"))), "")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def digest_id(prefix: str, digits: int, parts: Column) -> Column:
    """prefix + the first hex digits of the digest."""
    return F.concat(F.lit(prefix), F.substring(sha256_hex(parts), 1, digits))


def unit_joined(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *parts)


def printable(c: Column, most: int = 200) -> Column:
    """The first characters, control characters replaced."""
    return F.regexp_replace(F.substring(c, 1, most), r"\p{Cc}", "�")


def page_number(path: Column) -> Column:
    """The number behind the last hyphen of a file name; an error unless positive."""
    n = F.regexp_extract(path, r"-(\d+)\.[^./]*$", 1).try_cast("int")
    return F.when(n > 0, n).otherwise(F.raise_error(F.concat(F.lit("unexpected page name: "), path)).cast("int"))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.expr("true") & c.try_cast("date").isNotNull(), F.lit(False))


def is_web_url(c: Column) -> Column:
    """Null or an http(s) address with a host."""
    return c.isNull() | c.rlike(r"^(?i)https?://[^/?#]+")


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c

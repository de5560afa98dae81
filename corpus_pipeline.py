"""Corpus cleaning: language, quality, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm.common import stored, table
from folioscan.llm.exact_dedup import deduplicated
from folioscan.llm.language import in_known_language
from folioscan.llm.ngram_join import one_of_each
from folioscan.llm.packing import pack
from folioscan.llm.quality import good
from folioscan.llm.queries import tokenizer_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return in_known_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents that are left."""
    return good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle similarities of 0.8 or more the smallest id stays."""
    return one_of_each(docs, n=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return pack(docs, *tokenizer_files())


STAGES = [("language id", language), ("quality classifier", quality), ("exact dedup", exact_copies), ("ngram jaccard join", near_copies), ("packing", packing)]

#: The stages learn models and pack freely, which SQL can't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from .sentencepiece import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .chat import ORACLE as CHAT

    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op6_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER (PARTITION BY {folded}) AS keep_id, count(*) OVER (PARTITION BY {folded}) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY {folded}) AS kept, sha256({folded}) AS text_sha256
            FROM documents""",
        "op10_chat_formatting": CHAT,
        "op8_vector_search": """
            WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    }

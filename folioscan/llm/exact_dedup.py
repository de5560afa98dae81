"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Texts are equal when they are identical after folding A-Z. Instead of shuffling texts, every chunk of rows sends
each owner (a range of the fingerprint space) its sorted fingerprints as Golomb-Rice coded gaps; the owner sees
which occur more than once and answers each chunk with a bitmap. Only rows flagged there are suspects; their texts
are then compared byte for byte by grouping on the text itself, which Spark pre-aggregates before the shuffle, so
a group of copies of any size is one row per task.

Defined results: null texts equal the empty text; repeated rows and ids are rows of one group like any others, and
the largest id stays (null ids last); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, semi, stored, tuned, without

#: Most rows of a chunk, the unit that sends fingerprints and gets a bitmap, and fingerprints of an owner, on average;
#: least rows of either; parts that small tables have.
CHUNK_ROWS, OWNER_ROWS, LEAST_ROWS, PARTS = 1 << 19, 1 << 20, 4096, 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def rice_bits(n: int, span: int) -> int:
    """The Rice parameter for n sorted values in a range of span."""
    return max(0, (span // max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray, span: int) -> bytes:
    """Ascending values in [0, span) as Golomb-Rice coded gaps: all quotients in unary, then all low bits, k each."""
    if not len(values):
        return b""
    k = rice_bits(len(values), span)
    gaps = np.diff(values, prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1  # zeros, then the stop bit
    low = (gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1) if k else np.zeros((0, 0))
    return np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def decode(code: bytes, n: int, span: int) -> np.ndarray:
    """The inverse of encode(), without a loop over values: the n-th stop bit ends the quotients."""
    if not n:
        return np.zeros(0, np.uint64)
    k = rice_bits(n, span)
    low_bytes = -(-n * k // 8)
    data = np.frombuffer(code, np.uint8)
    stops = np.flatnonzero(np.unpackbits(data[: len(data) - low_bytes]))
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        low = np.unpackbits(data[len(data) - low_bytes :], count=n * k).reshape(n, k)
        gaps <<= np.uint64(k)
        for b in range(k):
            gaps |= low[:, b].astype(np.uint64) << np.uint64(k - 1 - b)
    return np.cumsum(gaps, dtype=np.uint64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256((t or b"").translate(_FOLD)).digest() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        prints = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 0].astype(np.int64) if digests else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prints)], ["doc_id", "digest", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the folded text), print (its first 64 bits), and the row's place: chunk, row. Small
    partitions share a chunk, so that a chunk's messages to owners stay long however many partitions there are."""
    made = docs.select("doc_id", "text").mapInArrow(_prints, "doc_id long, digest binary, print long")
    rows = stored(made.withColumn("row", F.monotonically_increasing_id()), "prints")  # written once: places never change afterwards
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    n, parts = rows.agg(F.count("*"), F.max(part) + 1).first()
    size = min(CHUNK_ROWS, max(LEAST_ROWS, n // PARTS))
    together = max(1, size * (parts or 1) // max(n, 1))
    return rows.withColumn("chunk", F.floor(part / together) * (1 << 20) + (place / size).cast("long"))


def _distinct(frame: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct fingerprints of a chunk, each row's place among them, and which are repeated inside it."""
    values, inverse, counts = np.unique(frame["print"].to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
    return values, inverse, counts > 1


def _sender(span: int):
    def send(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        """One chunk: a row for each owner that gets fingerprints of it, every one once."""
        prints = _distinct(frame)[0]
        owner = (prints // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(cuts[1:], len(prints))
        codes = [encode(prints[a:b] - np.uint64(int(owner[a]) * span), span) for a, b in zip(cuts, ends)]
        return pa.table({"owner": owner[cuts], "chunk": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "n": (ends - cuts).astype(np.int64), "code": pa.array(codes, pa.binary())})

    return send


def _answerer(span: int):
    def answer(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        """One owner: for each chunk a bitmap, in the order sent, of the fingerprints that other chunks have too."""
        parts = [decode(c, n, span) for c, n in zip(frame["code"].to_pylist(), frame["n"].to_pylist())]
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = np.split(counts[inverse] > 1, np.cumsum([len(p) for p in parts])[:-1])
        hit = [i for i, m in enumerate(many) if m.any()]
        return pa.table({
            "owner": pa.array([key[0].as_py()] * len(hit), pa.int64()), "chunk": frame["chunk"].take(pa.array(hit, pa.int64())).cast(pa.int64()),
            "bitmap": pa.array([np.packbits(many[i]).tobytes() for i in hit], pa.binary()),
        })

    return answer


def _flagger(span: int):
    def flag(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        """One chunk: its rows whose fingerprints occur twice in it, or that an owner has flagged."""
        values, inverse, flagged = _distinct(rows)
        owner = (values // np.uint64(span)).astype(np.int64)
        for o, bits in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist()):
            a, b = np.searchsorted(owner, [o, o + 1])
            flagged[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: b - a].astype(bool)
        return rows.select(["row", "doc_id", "digest"]).filter(pa.array(flagged[inverse]))

    return flag


def suspects(rows: DataFrame) -> DataFrame:
    """row, doc_id and digest of the rows whose fingerprint another row shares."""
    owners = max(PARTS, 1 << (rows.count() // OWNER_ROWS).bit_length())
    span = 2**64 // owners
    sent = rows.select("chunk", "print").groupBy("chunk").applyInArrow(_sender(span), "owner long, chunk long, n long, code binary")
    answers = sent.groupBy("owner").applyInArrow(_answerer(span), "owner long, chunk long, bitmap binary")
    light = rows.select("chunk", "row", "doc_id", "digest", "print")
    return light.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_flagger(span), "row long, doc_id long, digest binary")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    tuned(docs.sparkSession)
    rows = fingerprints(docs)
    found = stored(suspects(rows), "suspects")
    docs = docs.select("doc_id", "text")
    texts = semi(docs, found.select("doc_id"), "doc_id").unionByName(docs.filter("doc_id is null"))
    # the texts themselves are the key, so that equality is that of bytes
    same = texts.groupBy(ascii_lower(F.coalesce("text", F.lit(""))).alias("folded")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.filter("group_size > 1").select(F.unhex(F.sha2("folded", 256)).alias("digest"), "keep_id", "group_size")
    # of repeated rows with the largest id, the last stays
    last = found.groupBy("digest").agg(F.max(F.struct("doc_id", "row"))["row"].alias("keep_row"))
    same = same.join(last, "digest")
    out = rows.select("row", "doc_id", "digest").join(same, "digest", "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("row"),
    )


def row_key(doc_id, digest) -> F.Column:
    """A key of a row's id and text; a null id is an id of its own."""
    return F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"), F.lit(b" "), digest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the copies that do not stay: exactly one row of each text. Rows are told apart by id and
    text, so an id with two texts loses neither, a null id goes like any other, and of rows that repeat both one stays."""
    rows = exact_dedup(docs).select(row_key("doc_id", F.unhex("text_sha256")).alias("_row_key"), "kept")
    decided = stored(rows.groupBy("_row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("n > 1 or not kept"), "decided")
    folded = F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8")
    keyed = docs.withColumn("_row_key", row_key("doc_id", F.unhex(F.sha2(folded, 256))))
    repeated = decided.filter("kept").select("_row_key")
    once = without(keyed, decided.select("_row_key"), "_row_key")
    if not repeated.isEmpty():
        once = once.unionByName(semi(keyed, repeated, "_row_key").dropDuplicates(["_row_key"]))
    return once.drop("_row_key")

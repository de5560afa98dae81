"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector's residual from the mean is rotated at random and kept as the signs of its coordinates, its length and a
correction (the inner product of the code with the rotated direction). Code and correction give an unbiased
estimate of an inner product with a query, and a bound on its error that holds but for rare directions. In every
block a query reranks, by exact double-precision products, the vectors whose upper bound reaches the K-th best lower
bound; blocks' lists are merged by rank. Every row is indexed; the mean covers all rows.

Vectors are dealt to blocks by hash of the id, queries go to every block (they are the smaller side), and both
sides of a task are bounded. Vectors that are null, zero, of another length than most or hold null or non-finite
components take no part. Repeated ids are separate candidates, but a query is never its own id's neighbour, and equal queries are one; ties go
to the smaller id; with fewer than K candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tuned
from .sums import partition_sum

#: Vectors of a block, queries of a task, and the blocks that there are at least (with enough vectors).
BLOCK_ROWS, QUERY_ROWS, LEAST_BLOCKS = 131_072, 32_768, 8
#: Standard deviations that the error bound allows for.
DEVIATIONS, SEED = 4.0, 5


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual lengths and corrections of vectors."""
    rest = (x - mean) @ turn.T
    length = np.linalg.norm(rest, axis=1)
    correction = np.abs(rest).sum(1) / np.where(length > 0, length, 1) / math.sqrt(x.shape[1])
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, correction, 1.0)


def estimate(bits: np.ndarray, length: np.ndarray, correction: np.ndarray, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, queries by vectors, and bounds of their errors."""
    d = len(mean)
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * np.float32(2 / math.sqrt(d)) - np.float32(1 / math.sqrt(d))
    product = (queries @ turn.T).astype(np.float32) @ signs.T
    spread = length * np.sqrt(np.maximum(1 - correction**2, 0)) / correction / math.sqrt(max(d - 1, 1))
    return (queries @ mean)[:, None] + product * (length / correction), DEVIATIONS * np.linalg.norm(queries, axis=1)[:, None] * spread


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _rows(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, d)


def _searcher(mean: np.ndarray, turn: np.ndarray, k: int):
    d = len(mean)

    def search(key: tuple[pa.Scalar, ...], codes: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(codes) and len(queries):
            ids, x = codes["vec_id"].to_numpy(), _rows(codes["vector"], d)
            bits = np.frombuffer(b"".join(codes["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
            length, correction = codes["length"].to_numpy(), codes["correction"].to_numpy()
            names, q = queries["vec_id"].to_numpy(), _rows(queries["vector"], d)
            step = max(1, min(256, (1 << 22) // len(ids)))
            for i in range(0, len(q), step):
                guess, error = estimate(bits, length, correction, q[i : i + step], mean, turn)
                for j in range(len(guess)):
                    other = ids != names[i + j]
                    least = np.where(other, guess[j] - error[j], -np.inf)
                    kth = np.partition(least, len(least) - k)[len(least) - k] if len(least) >= k else -np.inf
                    at = np.flatnonzero((guess[j] + error[j] >= kth) & other)
                    scores = x[at] @ q[i + j]
                    best = top(ids[at], scores, k)
                    out += zip([int(names[i + j])] * len(best), ids[at][best].tolist(), scores[best].tolist())
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return search


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows to every row of vectors (vec_id, embedding) under is_query."""
    spark = tuned(vectors.sparkSession)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    d, n = sizes["d"], sizes["count"]
    rows = rows.filter(F.size("x") == d)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total += np.asarray(batch.column(0).flatten()).reshape(-1, d).sum(0)

    mean = partition_sum(rows.select("x"), d, add) / n
    turn = rotation(d)

    def code(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, d)
            bits, length, correction = encode(x, mean, turn)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(correction), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "bits", "length", "correction", "vector"]
            )

    index = stored(rows.select("vec_id", "x").mapInArrow(code, "vec_id long, bits binary, length double, correction double, vector binary"), "index")
    queries = index.filter(is_query).select("vec_id", "vector").distinct()
    asked = queries.count()
    if not asked:
        return empty
    blocks = max(-(-n // BLOCK_ROWS), min(LEAST_BLOCKS, -(-n // 1024)))
    parts = -(-asked // QUERY_ROWS)
    # vectors of a block meet every part of the queries, queries of a part every block
    left = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_searcher(mean, turn, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

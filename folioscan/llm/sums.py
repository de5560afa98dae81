"""Sums of fixed-size arrays over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that add up the partitions' arrays; the driver gets so many arrays.
ADDERS = 4


def partition_sum(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over partitions of a float64 array that add() fills from a partition's batches."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for batch in batches:
            if len(batch):
                add(total, batch)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % ADDERS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def merge(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in frame["total"]:
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(local, "part int, total binary").groupBy("part").applyInArrow(merge, "total binary").collect()
    return sum((np.frombuffer(r["total"], np.float64) for r in rows), np.zeros(size))

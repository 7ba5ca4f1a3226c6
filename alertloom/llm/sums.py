"""Sums of equally long rows of numbers over all tasks, added by groups of a few tasks, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task adds up.
FAN_IN = 16
_SCHEMA = "part long, sum binary"


def _row(part: int, total: np.ndarray) -> dict:
    return {"part": pa.array([part], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())}


def summed(rows: DataFrame, length: int, per_batch: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of all arrays (so many doubles each) that per_batch makes of the batches. rows must be a plain scan of a written table."""

    def run(batches):
        total, part = np.zeros(length), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                for own in per_batch(batch):
                    total += own.ravel()
        yield pa.RecordBatch.from_pydict(_row(part, total))

    def add(table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("part").to_pylist(), table.column("sum").to_pylist()))  # the same order in every attempt
        return pa.table(_row(own[0][0] // FAN_IN, sum((np.frombuffer(data, "<f8") for _, data in own), np.zeros(length))))

    parts = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, _SCHEMA)
    count = rows.rdd.getNumPartitions()
    while count > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(add, _SCHEMA)
        count = -(-count // FAN_IN)
    return sum((np.frombuffer(r["sum"], "<f8") for r in parts.collect()), np.zeros(length))  # one row, none for an empty table

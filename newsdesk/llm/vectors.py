"""Vectors on a grid of whole numbers, and sums over all of them that tasks take in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of this size or more have no place on a grid of longs.
LARGEST = 2.0**53


def on_grid(rows: DataFrame, steps: int, offset: int, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """``(vec_id, x, *more)``: floor(steps * component) + offset as longs, of the vectors that can be used.

    Vectors go that are null, empty, hold null or non-finite components or one beyond ``LARGEST``, or are of
    another length than most (of equally frequent lengths the longest counts).
    """
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"), *[F.col(c) for c in more])
    # NaN is above any number here.
    fits = lambda c: c.isNotNull() & (F.abs(c) < LARGEST)
    usable = given.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(F.forall("_v", fits), F.lit(False)))
    most = usable.groupBy(F.size("_v").alias("_d")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).first()
    usable = usable.filter(F.size("_v") == (most["_d"] if most else 0))
    return usable.select("vec_id", F.transform("_v", lambda c: F.floor(c * steps) + F.lit(offset).cast("long")).alias("x"), *more)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length, as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], width: int, whole: bool = False) -> dict[int, list]:
    """Row -> values of the sum of matrices ``of`` each batch, ``width`` wide.

    A task sends the sum of its batches, a row of it at a time, and Spark adds them row by row: the driver
    gets one matrix, whatever the number of tasks.  With ``whole`` they are longs, added exactly.
    """
    kind = pa.int64() if whole else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists(total, kind)], ["place", "part"])

    parts = df.mapInArrow(run, f"place int, part array<{'long' if whole else 'double'}>")
    value = (lambda k: F.col("part")[k].cast("decimal(38,0)")) if whole else (lambda k: F.col("part")[k])
    out = parts.groupBy("place").agg(*[F.sum(value(k)).alias(f"s{k}") for k in range(width)]).collect()
    return {r["place"]: [int(v) if whole else v for v in r[1:]] for r in out}


def halves(x: np.ndarray) -> np.ndarray:
    """Longs as two columns, their upper and lower 32 bits, whose sums over a task stay longs."""
    return np.stack([x >> 32, x & 0xFFFFFFFF], axis=-1)


def joined(high: int, low: int) -> int:
    return (high << 32) + low

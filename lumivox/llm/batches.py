"""Dictionaries of batches: documents name their items by place, each batch asks once for each distinct item it holds.

However often an item comes, it is asked for at most once a batch, so the
join that answers has no hot keys, and what goes back to a batch is bounded by
the batch's own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbers() -> Iterator[int]:
    """Numbers for the batches of the task that calls: its partition's number above, so no two tasks share one and a task that is run again gives the same."""
    return count(TaskContext.get().partitionId() << 32)


def first_row(values: pa.Array, rows: int) -> pa.Array:
    """A column of `rows` lists: all values in the first one, null in the others."""
    if not rows:
        return pa.array([], pa.list_(values.type))
    return pa.ListArray.from_arrays(pa.array([0, *[len(values)] * rows], pa.int32()), values, mask=pa.array([False] + [True] * (rows - 1)))


def planes(values: np.ndarray) -> bytes:
    """Small whole numbers as bytes, first all lowest ones, then all second ones: what is 0 stands together and takes no room in a shuffle."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def asked(rows: DataFrame, item: str, times: str) -> DataFrame:
    """batch, at, `item` and `times` for each item of each batch's dictionary; `rows` has lists of those names in one row of a batch."""
    pairs = rows.where(F.col(item).isNotNull()).select("batch", F.posexplode(F.arrays_zip(F.col(item).alias("item"), F.col(times).alias("times"))).alias("at", "pair"))
    return pairs.select("batch", "at", F.col("pair.item").alias(item), F.col("pair.times").alias(times))


def answered(rows: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(documents, answers) of each batch; `answers` has batch, at and what was asked for."""
    return rows.groupBy("batch").cogroup(answers.withColumnRenamed("batch", "asker").groupBy("asker")).applyInArrow(run, schema)

"""Vectors of one length that tasks hand on, added up by key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SALTS = 32


def salt() -> int:
    """For rows that a task hands on: tasks are spread over so many first sums of each key."""
    return TaskContext.get().partitionId() % SALTS


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a table of numbers as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows, float).ravel()))


def added(parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the sum of the vectors `value`, first by salt, then by key alone. Whole numbers below 2^53 are added exactly."""
    kinds = dict(parts.dtypes)

    def add(rows: pa.Table) -> pa.Table:
        numbers = rows[value].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = numbers.reshape(rows.num_rows, -1).sum(axis=0)
        return rows.slice(0, 1).set_column(rows.schema.get_field_index(value), value, lists(total[None]))

    for by in ([*keys, "salt"], list(keys)):
        names = [*by, value]
        parts = parts.select(*names).groupBy(*by).applyInArrow(add, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return parts

"""Columns over the ordered epochs of a recording.

Three edge rules live side by side: expanding statistics include the current row, rolling means renormalise at the edges
and go by rows, shifts go by the epoch index and leave a null where an epoch is missing. Missing values are nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import bind
from .recordings import map_recordings, running_robust

LEAST_ROWS = 20
LEAST_SCALE = 1e-12
LOW, HIGH = 0.05, 0.95


def _robust(x: Column, q: Column) -> Column:
    scale = q[2] - q[0]
    return F.when(scale > LEAST_SCALE, (x - q[1]) / scale)


def expanding_norm(x: Column, keys: Sequence[str], order: str, least: int = LEAST_ROWS) -> Column:
    """(x - median) / (q95 - q05) over the rows so far, from `least` values on."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.percentile(x, F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH))).over(w)
    now = F.struct(x.alias("x"), q.alias("q"), F.count(x).over(w).alias("n"))  # bound, so that there is one window of percentiles
    return bind(now, lambda v: F.when(v["n"] >= least, _robust(v["x"], v["q"])))


def posthoc_norm(x: Column, keys: Sequence[str]) -> Column:
    """The same over the whole recording."""
    q = F.percentile(x, F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH))).over(W.partitionBy(*keys))
    return bind(F.struct(x.alias("x"), q.alias("q")), lambda v: _robust(v["x"], v["q"]))


def expanding_median(x: Column, keys: Sequence[str], order: str) -> Column:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.percentile(x, F.lit(0.5)).over(w)


def expanding_spread(x: Column, keys: Sequence[str], order: str, least: float = 1e-6) -> Column:
    """q95 - q05 over the rows so far, never under `least`."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.percentile(x, F.array(F.lit(LOW), F.lit(HIGH))).over(w)
    return bind(q, lambda q: F.greatest(q[1] - q[0], F.lit(least)))


def triangular_mean(x: Column, keys: Sequence[str], order: str, width: int = 15) -> Column:
    """Centred mean with triangular weights over the rows and values there are."""
    half, w = width // 2, W.partitionBy(*keys).orderBy(order)
    total, mass = F.lit(0.0), F.lit(0.0)
    for d in range(-half, half + 1):
        value, weight = F.lag(x, d).over(w), 1 - abs(d) / (half + 1)
        total = total + F.coalesce(value * weight, F.lit(0.0))
        mass = mass + F.when(value.isNotNull(), weight).otherwise(0.0)
    return F.when(mass > 0, total / mass)


def trailing_mean(x: Column, keys: Sequence[str], order: str, n: int = 4) -> Column:
    return F.avg(x).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), W.currentRow))


def gap_shift(x: Column, keys: Sequence[str], order: str, offset: int) -> Column:
    """The value `offset` epochs ahead (or back), null where that epoch is missing."""
    w = W.partitionBy(*keys).orderBy(order)
    return F.when(F.lead(order, offset).over(w) == F.col(order) + offset, F.lead(x, offset).over(w))


def elapsed_hours(keys: Sequence[str], order: str, epoch_seconds: float = 30.0) -> Column:
    first = F.first(order).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (F.col(order) - first) * epoch_seconds / 3600


#: The look-ahead of a column that needs its whole recording: more than any delay.
WHOLE_RECORDING = 2**31 - 1


def look_ahead(column: str) -> int:
    """Epochs of future data that a column needs, by its name: _posthoc all, _c7min seven, _ep+k k."""
    if "_posthoc" in column:
        return WHOLE_RECORDING
    if column.endswith("_c7min"):
        return 7
    tail = column.rpartition("_ep+")[2]
    return int(tail) if "_ep+" in column and tail.isdigit() else 0


def normalise_wide(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], least: int = LEAST_ROWS) -> DataFrame:
    """expanding_norm of many columns at once, recording by recording, with a running order of each column's values.

    Adds <column>_norm. For wide tables and long recordings; a window expression orders all values so far anew for each row.
    """
    new = [f"{c}_norm" for c in columns]

    def kernel(rows: pa.Table) -> pa.Table:
        for c, n in zip(columns, new, strict=True):
            x = rows.column(c).cast(pa.float64()).to_numpy()
            rows = rows.append_column(n, pa.array(running_robust(x, least, LOW, HIGH, LEAST_SCALE), pa.float64(), from_pandas=True))
        return rows

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` double" for n in new)])
    return map_recordings(df, keys, order, kernel, schema)

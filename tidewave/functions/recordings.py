"""Kernels over whole recordings in Arrow batches, and the running order of a series."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def map_recordings(df: DataFrame, keys: Sequence[str], order: str, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """kernel(rows of a recording in order) for every recording.

    Recordings are dealt by key and come one after the other; a task holds one recording and the results of one batch.
    Rows of an empty table give nothing.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending = None, []

        def flush() -> pa.Table:
            return kernel(pa.Table.from_batches(pending).combine_chunks())

        for batch in batches:
            done, start = [], 0
            names = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            for i, name in enumerate(names):
                if name != current:
                    if i > start:
                        pending.append(batch.slice(start, i - start))
                    if pending:
                        done.append(flush())
                        pending.clear()
                    current, start = name, i
            pending.append(batch.slice(start))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if pending:
            yield from flush().combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(task, schema)


class RunningOrder:
    """The values of a series so far in order: quantiles after each value, for the cost of one insertion."""

    def __init__(self, values: list[float] | None = None):
        self.values: list[float] = values or []

    def __len__(self) -> int:
        return len(self.values)

    def add(self, value: float) -> None:
        insort(self.values, value)

    def rank(self, value: float) -> int:
        """How many values are less."""
        return bisect_left(self.values, value)

    def quantile(self, q: float) -> float:
        """Linear between the two nearest values."""
        at = q * (len(self.values) - 1)
        low = int(at)
        high = min(low + 1, len(self.values) - 1)
        return self.values[low] + (self.values[high] - self.values[low]) * (at - low)


def running_robust(x: np.ndarray, least: int, low: float, high: float, least_scale: float) -> np.ndarray:
    """(x - median) / (high quantile - low quantile) over the values so far; nan for missing, too few or no spread."""
    seen, out = RunningOrder(), np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        if v == v:
            seen.add(v)
            if len(seen) >= least:
                scale = seen.quantile(high) - seen.quantile(low)
                if scale > least_scale:
                    out[i] = (v - seen.quantile(0.5)) / scale
    return out


class RunningOrders:
    """Many series side by side, each of its values so far in order; missing values (nan) are no part of it.

    The order is kept as one table, so a value is put in by a search and a shift of numbers, and it goes to state and back as bytes.
    """

    def __init__(self, width: int, counts: bytes = b"", values: bytes = b""):
        self.counts = np.frombuffer(counts, np.int64).copy() if counts else np.zeros(width, np.int64)
        self.values = np.frombuffer(values, float).reshape(width, -1) if values else np.empty((width, 0))

    def state(self) -> tuple[bytes, bytes]:
        return self.counts.tobytes(), np.ascontiguousarray(self.values[:, : self.counts.max(initial=0)]).tobytes()

    def add(self, x: np.ndarray) -> None:
        width, room = self.values.shape
        if self.counts.max(initial=0) >= room:
            self.values = np.hstack([self.values, np.full((width, max(64, room)), np.inf)])
        there = ~np.isnan(x)
        at = np.where(there, (self.values < np.where(there, x, 0.0)[:, None]).sum(axis=1), self.values.shape[1])[:, None]
        place = np.arange(self.values.shape[1])
        moved = np.where(place > at, np.roll(self.values, 1, axis=1), self.values)
        self.values = np.where(place == at, x[:, None], moved)
        self.counts += there

    def quantile(self, q: float) -> np.ndarray:
        """Linear between the two nearest values; nan where there are none."""
        if not self.values.shape[1]:
            return np.full(len(self.counts), np.nan)
        last = np.maximum(self.counts - 1, 0)
        at = q * last
        low = at.astype(np.int64)
        high, row = np.minimum(low + 1, last), np.arange(len(last))
        a, b = self.values[row, low], self.values[row, high]
        with np.errstate(invalid="ignore"):
            return np.where(self.counts > 0, a + (b - a) * (at - low), np.nan)

"""Boosted trees for several classes, by histograms that Spark adds up.

Columns are binned once. In a round each class gets a tree, fitted to the gradients of the softmax loss: for each level one job
adds up gradients by class, node, column and bin, task by task; the best split of each node is chosen from the sums, and only
these splits come to the driver. Gradients are rounded to whole numbers, so their sums, and with them the trees, are the same however the
rows are dealt. Rows keep their scores; the table is cut from its lineage every few rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.lineage import cut
from tidewave.functions.vectors import added, lists, salt

UNIT = float(1 << 24)  # of the rounded gradients
CUT_EVERY = 10
#: Bits of a number that a bin can tell apart: sign, exponent and eleven digits of its fraction.
KEY_BITS = 20


def keys_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, by the upper bits of their single precision; nan is taken as 0."""
    bits = (np.nan_to_num(x, nan=0.0) + 0.0).astype(np.float32).view(np.int32).astype(np.int64)  # + 0.0: no negative zero
    size = bits & 0x7FFFFFFF
    return np.where(bits < 0, 0x7FFFFFFF - size, 0x80000000 + size) >> (32 - KEY_BITS)


@dataclass
class Tree:
    """A whole binary tree: of each inner node the column (-1: everything goes left) and the bin up to which rows go left."""

    columns: np.ndarray
    bins: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def nodes(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after `depth` levels, numbered from 0 within its level."""
        at, row = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for level in range(depth):
            node = at + (1 << level) - 1
            column = self.columns[node]
            right = (column >= 0) & (binned[row, np.maximum(column, 0)] > self.bins[node])
            at = 2 * at + right
        return at


@dataclass
class Boosted:
    """A fitted model. transform() adds `probability`, a vector by class, as Spark's own models do."""

    columns: list[str]
    edges: list[np.ndarray]
    start: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """[row, column] bins of values."""
        return np.stack([np.searchsorted(e, keys_of(x[:, j])) for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def scores(self, binned: np.ndarray, rounds: Sequence[list[Tree]]) -> np.ndarray:
        out = np.zeros((len(binned), len(self.start)))
        for trees in rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.values[tree.nodes(binned, self.depth)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        def found(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            p = softmax(self.start + self.scores(self.binned(x), self.rounds))
            return lists(p)

        proba = F.arrow_udf(found, "array<double>")(*[F.col(c).cast("double") for c in self.columns])
        return df.withColumn("probability", array_to_vector(proba))

    def note(self) -> dict:
        """Everything as plain values."""
        trees = [[{"columns": t.columns.tolist(), "bins": t.bins.tolist(), "values": t.values.tolist()} for t in r] for r in self.rounds]
        return {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "start": self.start.tolist(), "depth": self.depth, "rounds": trees, "gains": self.gains}

    @classmethod
    def of(cls, note: dict) -> Boosted:
        trees = [[Tree(np.array(t["columns"]), np.array(t["bins"]), np.array(t["values"])) for t in r] for r in note["rounds"]]
        return cls(note["columns"], [np.array(e, np.int64) for e in note["edges"]], np.array(note["start"]), note["depth"], trees, note["gains"])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(n)], axis=1)


def edges_of(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Of each column the greatest key in each of `bins` parts of about as many rows, but for the last, from exact counts of keys."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, len(columns))
            for j in range(len(columns)):
                key, n = np.unique(keys_of(x[:, j]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), j, np.int32)), pa.array(key), pa.array(n)], names=["j", "key", "n"])

    rows = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(count, "j int, key long, n long")
    counted = rows.groupBy("j", "key").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("j").orderBy("key"))
    part = F.floor((upto - 1) * bins / F.sum("n").over(W.partitionBy("j")))
    ends = counted.withColumn("part", part).groupBy("j", "part").agg(F.max("key").alias("key"))
    found: list[list[int]] = [[] for _ in columns]
    for r in ends.collect():  # bins rows per column
        found[r["j"]].append(r["key"])
    return [np.array(sorted(x)[:-1], np.int64) for x in found]


def _histograms(rows: DataFrame, model: Boosted, recent: list[list[Tree]], trees: list[Tree], level: int, bins: int) -> DataFrame:
    """(class, column, sums): gradients and their slopes by node of the level and bin, as one vector."""
    classes, width, nodes = len(model.start), len(model.columns), 1 << level

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, width, 2, nodes * bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            binned = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            score = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(-1, classes)
            p = softmax(score + model.scores(binned, recent))
            for k in range(classes):
                first = np.rint(weight * (p[:, k] - (label == k)) * UNIT)
                second = np.rint(weight * p[:, k] * (1 - p[:, k]) * UNIT)
                node = trees[k].nodes(binned, level) * bins
                for j in range(width):
                    at = node + binned[:, j]
                    sums[k, j, 0] += np.bincount(at, first, nodes * bins)
                    sums[k, j, 1] += np.bincount(at, second, nodes * bins)
        flat = sums.reshape(classes * width, -1)
        if flat.any():
            of = np.arange(classes * width)
            numbers = [of // width, of % width, np.full(len(of), salt())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in numbers), lists(flat)], names=["class", "column", "salt", "sums"])

    parts = rows.select("binned", "label", "weight", "score").mapInArrow(add, "class int, column int, salt int, sums array<double>")
    return added(parts, ["class", "column"], "sums")


def _splits(sums: DataFrame, level: int, bins: int, ridge: float, least: float) -> list:
    """Of each class and node of a level its sums, and the split of the greatest gain; of equals the first column, then the first bin."""
    nodes = 1 << level

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, j, values in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).to_pylist(), strict=True):
                g, h = np.array(values).reshape(2, nodes, bins)
                left_g, left_h = g.cumsum(axis=1), h.cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain = np.where((left_h >= least) & (all_h - left_h >= least), gain, -1.0)
                at = gain.argmax(axis=1)
                for node in range(nodes):
                    b = at[node]
                    out.append((k, node, j, int(b), float(gain[node, b]), left_g[node, b], left_h[node, b], all_g[node, 0], all_h[node, 0]))
            kinds = [pa.int32()] * 4 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=list(names))

    names = ("class", "node", "column", "bin", "gain", "left_g", "left_h", "g", "h")
    rows = sums.mapInArrow(best, ", ".join(f"{n} {'int' if i < 4 else 'double'}" for i, n in enumerate(names)))
    first = W.partitionBy("class", "node").orderBy(F.desc("gain"), "column", "bin")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").collect()  # a row per class and node


def fit(
    df: DataFrame, columns: Sequence[str], label: str, classes: int, *, weight: str | None = None,
    rounds: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0,
) -> Boosted:
    """A model of label (0 to classes - 1) by columns, whose missing values count as zero.

    ridge and least are in rows: what is added to a node's slopes, and the least that either side of a split must have.
    """
    if not 2 <= bins <= 256 or depth < 1 or rounds < 1 or classes < 2:
        raise ValueError("boosting takes 2 to 256 bins, a depth and a round at least, and two classes or more")
    columns = list(columns)
    given = df.select(*[F.col(c).cast("double") for c in columns], F.col(label).cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"))
    totals = {r["label"]: r["w"] for r in given.groupBy("label").agg(F.sum("weight").alias("w")).collect()}  # a row per class
    share = np.array([max(totals.get(k) or 0.0, 1e-9) for k in range(classes)])
    start = np.round(np.log(share / share.sum()), 9)
    model = Boosted(columns, edges_of(given, columns, bins), start, depth, gains=dict.fromkeys(columns, 0.0))

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = start.tobytes()
        for batch in batches:
            binned = model.binned(_matrix(batch, len(columns))) if batch.num_rows else np.zeros((0, len(columns)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned], pa.binary()), batch.column(len(columns)), batch.column(len(columns) + 1), pa.array([first] * batch.num_rows, pa.binary())], names=["binned", "label", "weight", "score"])

    schema = "binned binary, label int, weight double, score binary"
    rows = cut(given.mapInArrow(prepare, schema))
    recent: list[list[Tree]] = []
    for turn in range(rounds):
        trees = [Tree(np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)) for _ in range(classes)]
        held = [dict() for _ in range(classes)]  # sums of the nodes of the next level
        for level in range(depth):
            found = {(r["class"], r["node"]): r for r in _splits(_histograms(rows, model, recent, trees, level, bins), level, bins, ridge * UNIT, least * UNIT)}
            below: list[dict] = [dict() for _ in range(classes)]
            for (k, node), r in found.items():
                at = node + (1 << level) - 1
                left = (r["left_g"], r["left_h"])
                if r["gain"] > 0:
                    trees[k].columns[at], trees[k].bins[at] = r["column"], r["bin"]
                    model.gains[columns[r["column"]]] += r["gain"] / UNIT
                    below[k][2 * node], below[k][2 * node + 1] = left, (r["g"] - left[0], r["h"] - left[1])
                else:
                    below[k][2 * node], below[k][2 * node + 1] = (r["g"], r["h"]), (0.0, 0.0)
            held = below
        for k, tree in enumerate(trees):
            sums = np.array([held[k].get(i, (0.0, 0.0)) for i in range(1 << depth)])
            tree.values = -rate * sums[:, 0] / (sums[:, 1] + ridge * UNIT)
        model.rounds.append(trees)
        recent.append(trees)
        if len(recent) == CUT_EVERY and turn + 1 < rounds:
            passed = list(recent)

            def go_on(batches: Iterable[pa.RecordBatch], passed=passed) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    binned = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(columns))
                    score = np.frombuffer(b"".join(batch.column(3).to_pylist())).reshape(-1, classes) + model.scores(binned, passed)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in score], pa.binary())], names=batch.schema.names)

            older, rows = rows, cut(rows.mapInArrow(go_on, schema))
            older.unpersist()
            recent = []
    rows.unpersist()
    return model

"""Staging epoch by epoch: a stateful stream that decides as the batch does, a fixed number of epochs later.

A session's epochs come as feature arrays (Stager) or as raw signals (RawStager), numbered by `seq`. A raw epoch is filtered first:
without delay by a causal filter whose state is carried on, or by a zero-phase filter over a ring of the last five epochs, which
gives the middle one, so two epochs later; when the ring is first full its first two epochs follow from it as well, and the
last two of a session are never decided. The features are then normalised by the session so far, kept until the epochs that their
smoothing looks ahead to are there, scored by a linear model and decoded past-only. An `ended` row lets out what still
waits, with the context there is. State per session: the values of each feature so far in order (the norm is over all of
them), the last normalised rows, the ring or the filter's state, counters and the decoder's vector; Spark's checkpoint
keeps it, so a restarted query goes on unchanged. An epoch that was seen before (seq not above the last) is ignored.
Missing values are nulls and become zero for the model. Raw epochs of a wrong shape don't reach the state: `well_formed` tells
them apart, and `split` gives them as a table of their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewave.functions import windows as X
from tidewave.functions.arrays import total
from tidewave.functions.recordings import RunningOrders
from tidewave.operators import spectra
from tidewave.operators.decoding import LEAST, forward

AHEAD, BACK, TRAIL = 7, 7, 4
#: Epochs on either side that a zero-phase filter is given.
PAD = 2
OUTPUT = "session string, seq long, stage int, confidence double, proba array<double>"


@dataclass(frozen=True)
class LinearStager:
    """coef [class][3 * features] over (norm, centred mean, trailing mean) of each feature; log_prob [from][to] or None.

    A model that never saw some of n_classes names in `classes` those that its rows stand for; the others have probability zero.
    """

    coef: tuple
    intercept: tuple
    log_prob: tuple | None = None
    weight: float = 0.0
    classes: tuple | None = None
    n_classes: int | None = None

    def __post_init__(self):
        known = self.known
        if len(known) != len(self.intercept) or len(self.coef) != len(known) or sorted(set(known)) != sorted(known) or not all(0 <= c < self.size for c in known):
            raise ValueError("a model has a row of coefficients for each of its classes")
        if self.log_prob is not None and (len(self.log_prob) != self.size or any(len(r) != self.size for r in self.log_prob)):
            raise ValueError("the table of transitions has a row and a column for each class")

    @property
    def known(self) -> tuple:
        return self.classes if self.classes is not None else tuple(range(len(self.intercept)))

    @property
    def size(self) -> int:
        return self.n_classes or len(self.intercept)

    def proba(self, row: np.ndarray) -> np.ndarray:
        score = np.asarray(self.coef) @ np.nan_to_num(row) + np.asarray(self.intercept)
        e = np.exp(score - score.max())
        out = np.zeros(self.size)
        out[list(self.known)] = e / e.sum()
        return out

    def step(self, alpha: np.ndarray | None, proba: np.ndarray) -> np.ndarray:
        e = np.log(np.maximum(proba, LEAST))
        if alpha is None or self.log_prob is None:
            return e
        moved = alpha[:, None] + self.weight * np.asarray(self.log_prob)
        top = moved.max(axis=0)
        return e + top + np.log(np.exp(moved - top).sum(axis=0))


def _norm(orders: RunningOrders, x: np.ndarray) -> np.ndarray:
    """x normalised by a session so far, of which it becomes part; columns with too few values or no spread are nan."""
    orders.add(x)
    scale = orders.quantile(X.HIGH) - orders.quantile(X.LOW)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((orders.counts >= X.LEAST_ROWS) & (scale > X.LEAST_SCALE), (x - orders.quantile(0.5)) / scale, np.nan)


def _weighted(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    there = ~np.isnan(rows) * weight[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nansum(rows * weight[:, None], axis=0) / np.where(there.sum(axis=0) > 0, there.sum(axis=0), np.nan)


class Stager(StatefulProcessor):
    """Epochs as feature arrays."""

    def __init__(self, model: LinearStager):
        self.model = model

    def init(self, handle) -> None:
        self.counters = handle.getValueState("counters", "received long, decided long, last long, alpha array<double>")
        self.order = handle.getValueState("order", "width int, counts binary, values binary")
        self.recent = handle.getListState("recent", "seq long, z array<double>")

    def open(self) -> None:
        """Reads what a kind of stager keeps besides."""

    def keep(self) -> None:
        """Writes it."""

    def drop(self) -> None:
        """Clears it at the end of a session."""

    def features(self, row) -> Iterator[tuple[int, np.ndarray]]:
        """(seq, features) of the epochs that are known once this row has come."""
        yield int(row.seq), np.array([np.nan if v is None else v for v in row.features], float)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """Takes over a session as session_state() gave it."""
        for r in initialState.itertuples():
            alpha = [] if r.alpha is None else [float(v) for v in r.alpha]
            self.counters.update((int(r.received), int(r.decided), int(r.last), alpha))
            if r.counts is not None:
                self.order.update((int(r.width), bytes(r.counts), bytes(r.values)))
            if r.recent is not None and len(r.recent):
                self.recent.put([(int(e["seq"]), [float(v) for v in e["z"]]) for e in r.recent])
            self.take_over(r)

    def take_over(self, row) -> None:
        """Puts what a kind of stager keeps besides."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ended", "seq"], kind="stable")
        received, decided, last, alpha = self.counters.get() if self.counters.exists() else (0, 0, -1, None)
        alpha = None if alpha is None or not len(alpha) else np.array(alpha, float)
        orders = None
        if self.order.exists():
            width, counts, values = self.order.get()
            orders = RunningOrders(width, bytes(counts), bytes(values))
        kept = list(self.recent.get())
        seqs, recent = [k[0] for k in kept], [np.array(k[1], float) for k in kept]
        self.open()
        out, ended = [], False

        def decide() -> None:
            nonlocal decided, alpha
            first = received - len(recent)
            index = np.arange(first, received)
            z = np.array(recent)
            near = np.maximum(0.0, 1 - np.abs(index - decided) / (AHEAD + 1))
            trail = ((index <= decided) & (index > decided - TRAIL)).astype(float)
            row = np.concatenate([z[decided - first], _weighted(z, near), _weighted(z, trail)])
            proba = self.model.proba(row)
            alpha = self.model.step(alpha, proba)
            stage = int(np.argmax(alpha))
            out.append((key[0], seqs[decided - first], stage, float(proba[stage]), proba.tolist()))
            decided += 1

        for r in frame.itertuples():
            if r.ended:
                ended = True
                while decided < received:
                    decide()
                continue
            if r.seq <= last:
                continue
            last = r.seq
            for seq, x in self.features(r):
                orders = orders or RunningOrders(len(x))
                recent.append(_norm(orders, x))
                seqs.append(seq)
                received += 1
                if received - 1 - AHEAD >= decided:
                    decide()
                recent, seqs = recent[-(BACK + AHEAD + 1) :], seqs[-(BACK + AHEAD + 1) :]
        if ended:  # a finished session keeps its counters alone, so that epochs sent again are still known
            self.order.clear()
            self.recent.clear()
            self.drop()
        else:
            if orders:
                self.order.update((len(orders.counts), *orders.state()))
            if recent:
                self.recent.put([(q, z.tolist()) for q, z in zip(seqs, recent, strict=True)])
            self.keep()
        self.counters.update((received, decided, int(last), [] if alpha is None else alpha.tolist()))
        yield pd.DataFrame(out, columns=["session", "seq", "stage", "confidence", "proba"])

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Recorder:
    """How raw epochs are: their channels, rate and samples, the filter's mode, and families of features that are left out."""

    channels: tuple
    rate: float
    samples: int
    mode: str = "zerophase"
    without: tuple = ()

    def __post_init__(self):
        if self.mode not in spectra.MODES:
            raise ValueError(f"unknown filter {self.mode}; known: {', '.join(spectra.MODES)}")

    @property
    def delay(self) -> int:
        """Epochs from an epoch's coming to its decision: those of the smoothing and those of the filter."""
        return AHEAD + (PAD if self.mode == "zerophase" else 0)

    @property
    def names(self) -> list[str]:
        return spectra.feature_names(self.rate, self.channels, self.samples, self.without)

    def features(self, x: np.ndarray) -> np.ndarray:
        """[epoch, feature] of filtered epochs [epoch, channel, sample]."""
        found = spectra.epoch_kernel(x, self.rate, self.channels, self.without)
        return np.stack(list(found.values()), axis=1)


class RawStager(Stager):
    """Epochs as raw signals [channel][sample]."""

    def __init__(self, model: LinearStager, recorder: Recorder):
        super().__init__(model)
        self.recorder = recorder

    def init(self, handle) -> None:
        super().init(handle)
        self.ring_state = handle.getListState("ring", "seq long, x binary")
        self.filter_state = handle.getValueState("filter", "z binary")

    def open(self) -> None:
        self.shape = (len(self.recorder.channels), self.recorder.samples)
        self.sections = spectra.butterworth(spectra.ORDER, *spectra.WHOLE, self.recorder.rate)
        self.ring = deque(((r[0], np.frombuffer(bytes(r[1])).reshape(self.shape)) for r in self.ring_state.get()), maxlen=2 * PAD + 1)
        self.z = np.frombuffer(bytes(self.filter_state.get()[0])).reshape(len(self.sections), 2, -1) if self.filter_state.exists() else None

    def keep(self) -> None:
        if self.ring:
            self.ring_state.put([(seq, x.tobytes()) for seq, x in self.ring])
        if self.z is not None:
            self.filter_state.update((np.ascontiguousarray(self.z).tobytes(),))

    def take_over(self, row) -> None:
        if row.ring is not None and len(row.ring):
            self.ring_state.put([(int(e["seq"]), bytes(e["x"])) for e in row.ring])
        if row.z is not None:
            self.filter_state.update((bytes(row.z),))

    def drop(self) -> None:
        self.ring_state.clear()
        self.filter_state.clear()

    def features(self, row) -> Iterator[tuple[int, np.ndarray]]:
        x = np.array([np.asarray(c, float) for c in row.signal])
        if self.recorder.mode == "none":
            found = [(int(row.seq), x)]
        elif self.recorder.mode == "causal":
            y, self.z = spectra.filter_on(self.sections, x, self.z)
            found = [(int(row.seq), y)]
        else:
            filling = len(self.ring) < 2 * PAD + 1
            self.ring.append((int(row.seq), x))
            if len(self.ring) < 2 * PAD + 1:
                return
            y = spectra.zero_phase(self.sections, np.concatenate([e for _, e in self.ring], axis=-1)).reshape(self.shape[0], -1, self.shape[1])
            found = [(self.ring[i][0], y[:, i]) for i in range(0 if filling else PAD, PAD + 1)]
        for (seq, _), values in zip(found, self.recorder.features(np.stack([e for _, e in found])), strict=True):
            yield seq, values


def session_state(spark: SparkSession, checkpoint: str, raw: bool = False) -> DataFrame:
    """What a stopped query keeps of each session, from its checkpoint, for another query to go on with; `raw` for a RawStager's."""

    def read(name: str, *fields: str) -> DataFrame:
        found = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        return found.select(F.col("key.session").alias("session"), *[F.col(f"value.{f}").alias(f) for f in fields])

    def listed(name: str, to: str) -> DataFrame:
        found = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True).load(checkpoint)
        return found.groupBy(F.col("key.session").alias("session")).agg(F.array_sort(F.collect_list("list_element")).alias(to))

    out = read("counters", "received", "decided", "last", "alpha")
    parts = [read("order", "width", "counts", "values"), listed("recent", "recent")]
    if raw:
        parts += [listed("ring", "ring"), read("filter", "z")]
    for part in parts:
        out = out.join(part, "session", "left")
    return out


def stage_stream(epochs: DataFrame, model: LinearStager, recorder: Recorder | None = None, state: DataFrame | None = None) -> DataFrame:
    """Decisions (OUTPUT) for a stream of session, seq, ended, and features or, with a recorder, signal.

    With the session_state() of another query, its sessions go on as if they had never stopped.
    """
    what = "features" if recorder is None else "signal"
    rows = epochs.select("session", F.col("seq").cast("long").alias("seq"), what, F.coalesce("ended", F.lit(False)).alias("ended"))
    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Stager(model) if recorder is None else RawStager(model, recorder), outputStructType=OUTPUT, outputMode="Append", timeMode="None",
        initialState=None if state is None else state.groupBy("session"),
    )


def well_formed(signal: Column, recorder: Recorder) -> Column:
    """Whether a signal has the recorder's channels and samples, and no missing sample."""
    whole = F.forall(signal, lambda c: (F.size(c) == recorder.samples) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v)))
    return F.coalesce((F.size(signal) == len(recorder.channels)) & whole, F.lit(False))


def split(epochs: DataFrame, recorder: Recorder) -> tuple[DataFrame, DataFrame]:
    """(epochs that can be staged, and ends of sessions; malformed epochs), of a stream or a table."""
    good = F.coalesce("ended", F.lit(False)) | well_formed(F.col("signal"), recorder) & F.col("seq").isNotNull() & F.col("session").isNotNull()
    return epochs.filter(good), epochs.filter(~good)


def filtered_batch(epochs: DataFrame, recorder: Recorder) -> DataFrame:
    """session, seq, signal: whole sessions filtered as the stream does."""
    rows = epochs.filter(~F.coalesce("ended", F.lit(False))).select("session", "seq", F.col("signal").cast("array<array<double>>").alias("signal"))
    if recorder.mode != "zerophase":
        return spectra.filter_recordings(rows, ["session"], "seq", "signal", recorder.rate, recorder.mode)
    by, width = W.partitionBy("session"), 2 * PAD + 1
    order = by.orderBy("seq")
    rows = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    near = F.collect_list("signal").over(order.rowsBetween(-PAD, PAD))
    for i in range(PAD):  # the first ones lie at the beginning of the first ring
        near = F.when(F.col("_i") == i, F.collect_list("signal").over(order.rowsBetween(-i, width - 1 - i))).otherwise(near)
    rings = rows.withColumn("_ring", near).filter((F.col("_n") >= width) & (F.col("_i") < F.col("_n") - PAD))
    return spectra.filter_windows(rings.select("session", "seq", F.least("_i", F.lit(PAD)).alias("_at"), "_ring"), recorder.rate, len(recorder.channels), recorder.samples)


def stage_raw_batch(epochs: DataFrame, model: LinearStager, recorder: Recorder) -> DataFrame:
    """The same decisions for whole sessions of raw epochs."""
    clean = filtered_batch(epochs, recorder)
    found = spectra.epoch_features(clean, ["session", "seq"], "signal", recorder.rate, recorder.channels, recorder.samples, recorder.without)
    return stage_batch(found.withColumn("ended", F.lit(False)), model, len(recorder.names))


def stage_batch(epochs: DataFrame, model: LinearStager, width: int) -> DataFrame:
    """The same decisions for whole sessions, in DataFrame functions; `width` features."""
    keys = ["session"]
    rows = epochs.filter(~F.coalesce("ended", F.lit(False))).select("session", "seq", *[F.get("features", F.lit(j)).alias(f"x{j}") for j in range(width)])
    rows = rows.select("session", "seq", *[X.expanding_norm(F.col(f"x{j}"), keys, "seq").alias(f"z{j}") for j in range(width)])
    z = [F.col(f"z{j}") for j in range(width)]
    parts = [*z, *[X.triangular_mean(c, keys, "seq") for c in z], *[X.trailing_mean(c, keys, "seq", TRAIL) for c in z]]
    rows = rows.select("session", "seq", F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]).alias("f"))
    score = F.array(*[
        F.lit(float(b)) + total(F.zip_with("f", F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y))
        for w, b in zip(model.coef, model.intercept, strict=True)
    ])
    rows = rows.withColumn("s", score).withColumn("e", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    share = F.transform("e", lambda v: v / total(F.col("e")))
    n, known = model.size, list(model.known)
    rows = rows.withColumn("proba", share if known == list(range(n)) else F.array(*[F.get(share, F.lit(known.index(c))) if c in known else F.lit(0.0) for c in range(n)]))
    table = model.log_prob if model.log_prob is not None else [[0.0] * n for _ in range(n)]
    weight = model.weight if model.log_prob is not None else 0.0
    found = forward(rows, keys, "seq", "proba", table, weight)
    found = found.join(rows.select("session", "seq", "proba"), ["session", "seq"])
    return found.select("session", "seq", "stage", F.get("proba", F.col("stage")).alias("confidence"), "proba")

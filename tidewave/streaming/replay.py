"""Stored recordings as a stream, as if they were being recorded, and the figures of such a run.

`store` lays epochs down by session in order, with an end of each session behind its last epoch. The source `tidewave_replay` releases
epoch number t of every session once t * seconds / speed have passed since `began`, so what is there at a moment follows
from the clock alone: a query that is started again from its checkpoint, with the same options, goes on where it stopped and
repeats nothing. Tasks read only the row groups whose epochs are due.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

from tidewave.sources.edf import list_files, open_file

SCHEMA = "session string, seq long, signal array<array<double>>, ended boolean"
COLUMNS = ["session", "seq", "signal", "ended"]
ROW_GROUP_BYTES = 4 << 20


def store(epochs: DataFrame, path: str) -> None:
    """Writes session, seq, signal for a replay. Sessions are dealt by key and lie in order, in row groups of about ROW_GROUP_BYTES."""
    rows = epochs.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), F.col("signal").cast("array<array<double>>").alias("signal"), F.lit(False).alias("ended"))
    ends = rows.groupBy("session").agg((F.max("seq") + 1).alias("seq")).select("session", "seq", F.lit(None).cast("array<array<double>>").alias("signal"), F.lit(True).alias("ended"))
    laid = rows.unionByName(ends).repartition("session").sortWithinPartitions("session", "seq")
    laid.write.option("parquet.block.size", ROW_GROUP_BYTES).mode("error").parquet(path)


@dataclass
class Due(InputPartition):
    """The epochs from `first` up to `stop` in some row groups of a file."""

    path: str
    groups: tuple
    first: int
    stop: int


class ReplayReader(DataSourceStreamReader):
    def __init__(self, path: str, began: float, seconds: float, speed: float, most: int):
        self.path, self.began, self.seconds, self.speed, self.most = path, began, seconds, speed, most
        self.held: list[tuple[str, int, int, int]] | None = None

    def _groups(self) -> list[tuple[str, int, int, int]]:
        """(file, row group, least and greatest seq) from the files' footers, which are read once."""
        if self.held is None:
            self.held = []
            for path, _ in list_files(self.path, "*.parquet"):
                with open_file(path) as file:
                    meta = pq.ParquetFile(file).metadata
                at = meta.schema.names.index("seq")
                for g in range(meta.num_row_groups):
                    seq = meta.row_group(g).column(at).statistics
                    self.held.append((path, g, seq.min, seq.max))
        return self.held

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        end = max((g[3] for g in self._groups()), default=-1) + 1
        due = int((time.time() - self.began) * self.speed / self.seconds) + 1
        return {"seq": max(0, min(end, due))}

    def partitions(self, start: dict, end: dict) -> list[Due]:
        """Tasks of at most `most` row groups of one file that have epochs in the range."""
        files: dict[str, list[int]] = {}
        for path, g, low, high in self._groups():
            if low < end["seq"] and high >= start["seq"]:
                files.setdefault(path, []).append(g)
        return [Due(p, tuple(gs[i : i + self.most]), start["seq"], end["seq"]) for p, gs in files.items() for i in range(0, len(gs), self.most)]

    def read(self, part: Due) -> Iterator[pa.RecordBatch]:
        with open_file(part.path) as file:
            stored = pq.ParquetFile(file)
            for g in part.groups:
                rows = stored.read_row_group(g, columns=COLUMNS)
                due = pc.and_(pc.greater_equal(rows["seq"], part.first), pc.less(rows["seq"], part.stop))
                yield from rows.filter(due).select(COLUMNS).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is kept for what has been read."""


class ReplaySource(DataSource):
    """spark.readStream.format("tidewave_replay"): options path, began (seconds since 1970), seconds (of an epoch), speed, groups."""

    @classmethod
    def name(cls) -> str:
        return "tidewave_replay"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ReplayReader:  # noqa: N802
        o = self.options
        if "began" not in o:
            raise ValueError("a replay needs the time at which it began, so that it can be gone on with")
        return ReplayReader(o["path"], float(o["began"]), float(o.get("seconds", 30)), float(o.get("speed", 1)), int(o.get("groups", 8)))


def stream(spark: SparkSession, path: str, began: float, *, seconds: float = 30.0, speed: float = 1.0) -> DataFrame:
    """The stored sessions as a stream of session, seq, signal, ended."""
    spark.dataSource.register(ReplaySource)
    found = spark.readStream.format("tidewave_replay").option("began", repr(float(began))).option("seconds", seconds).option("speed", speed)
    return found.load(path)


class Latency(StreamingQueryListener):
    """Milliseconds an epoch of a query's micro-batches: what a batch took, shared by its rows."""

    def __init__(self):
        self.batches: list[tuple[int, float]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.numInputRows:
            self.batches.append((event.progress.numInputRows, float(event.progress.batchDuration)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def figures(self) -> dict[str, float]:
        """mean over all epochs, and the 95th percentile and most over epochs, each taking its batch's share."""
        if not self.batches:
            return {"mean": 0.0, "p95": 0.0, "max": 0.0}
        n, ms = np.array(self.batches, float).T
        each = np.repeat(ms / n, n.astype(int))
        return {"mean": float(ms.sum() / n.sum()), "p95": float(np.percentile(each, 95)), "max": float(each.max())}


def figures(decisions: DataFrame, labels: DataFrame, delay: int) -> DataFrame:
    """Of each session: n_epochs (fed), warm_up, n_decisions and accuracy after the warm-up, delay, first_answer_after.

    labels has session, seq, stage and warm_up, the epochs at the beginning that are played but not judged. A session without
    decisions after its warm-up has accuracy 0.
    """
    fed = labels.groupBy("session").agg(F.count(F.lit(1)).alias("n_epochs"), F.max("warm_up").alias("warm_up"))
    judged = labels.join(decisions.select("session", "seq", F.col("stage").alias("_own")), ["session", "seq"], "left")
    late = F.col("_own").isNotNull() & (F.col("seq") >= F.col("warm_up"))
    found = judged.groupBy("session").agg(
        F.count_if(late).alias("n_decisions"), F.count_if(late & (F.col("_own") == F.col("stage"))).alias("_right"),
        F.min(F.when(F.col("_own").isNotNull(), F.col("seq"))).alias("_first"),
    )
    return fed.join(found, "session").select(
        "session", "n_epochs", "warm_up", "n_decisions", (F.col("_right") / F.greatest("n_decisions", F.lit(1))).alias("accuracy"),
        F.lit(delay).alias("delay"), (F.col("_first") + delay).alias("first_answer_after"),
    )

"""Where results go: decisions upserted by key, an audit trail, importance tables and JSON notes beside tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators.tables import keep_last


def append_versions(path: str, key: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch with its number, of each key the last row by `order`.

    Rows are never rewritten; a batch that comes again adds nothing new.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = keep_last(batch, key, [F.col(c) for c in order]) if key else batch
        once.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders `kind`=number whose writing is finished, in order."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    names = [f.getPath().getName() for f in system.listStatus(top) if f.isDirectory()]
    numbers = [int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in numbers if system.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}/_SUCCESS")))


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot, if there is one, and the batches since; each row with its batch."""
    snapshot = max(_finished(spark, f"{path}/snapshots", "upto"), default=None)
    batches = [n for n in _finished(spark, path, "batch") if snapshot is None or n > snapshot]
    found = [spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches])] if batches else []
    found = [df.withColumn("batch", F.col("batch").cast("long")) for df in found]
    if snapshot is not None:
        found.insert(0, spark.read.parquet(f"{path}/snapshots/upto={snapshot}"))
    if not found:
        raise ValueError(f"{path} has no finished batch")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def current(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The last version of each key, from the last snapshot and the batches since."""
    return keep_last(_versions(spark, path), key, [F.col("batch")])


def compact(spark: SparkSession, path: str, key: Sequence[str]) -> int | None:
    """Puts the last versions of all finished batches into a snapshot, which counts once it is whole, and returns its last batch.

    Reading then takes the snapshot and later batches alone. A reader that began before goes on with what it found: old files stay
    until they are vacuumed. A batch that is written again afterwards is in the snapshot already.
    """
    batches = _finished(spark, path, "batch")
    done = max(_finished(spark, f"{path}/snapshots", "upto"), default=None)
    if not batches or done is not None and batches[-1] <= done:
        return done
    current(spark, path, key).write.mode("overwrite").parquet(f"{path}/snapshots/upto={batches[-1]}")
    return batches[-1]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the last `keep` snapshots, and the batches that are in the oldest of those kept."""
    if keep < 1:
        raise ValueError("one snapshot at least must be kept")
    snapshots = _finished(spark, f"{path}/snapshots", "upto")
    if not snapshots:
        return
    oldest = snapshots[-keep:][0]
    gone = [f"{path}/snapshots/upto={n}" for n in snapshots[:-keep]] + [f"{path}/batch={n}" for n in _finished(spark, path, "batch") if n <= oldest]
    jvm = spark.sparkContext._jvm
    for folder in gone:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def audit(df: DataFrame, path: str, event: str, detail: str = "", model_version: str = "") -> None:
    """Append one row per session: session, event, detail, model_version, created_at."""
    rows = df.select("session").distinct().select("session", F.lit(event).alias("event"), F.lit(detail).alias("detail"), F.lit(model_version).alias("model_version"), F.current_timestamp().alias("created_at"))
    rows.write.mode("append").parquet(path)


def write_importance(df: DataFrame, path: str) -> None:
    """feature, importance as one CSV file, greatest first; one row per column of a feature table."""
    df.select("feature", "importance").orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_note(spark: SparkSession, note: dict, path: str) -> None:
    """A JSON object (a manifest, metrics, a card) as a one-line text file, through Spark so that any store will do."""
    spark.createDataFrame([(json.dumps(note, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_note(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def history(spark: SparkSession, path: str, session: str) -> DataFrame:
    """A session's decisions in order."""
    return current(spark, path, ["session", "seq"]).filter(F.col("session") == session).orderBy("seq")


def latest_position(df: DataFrame) -> DataFrame:
    """Per session the last decided epoch."""
    w = W.partitionBy("session").orderBy(F.desc("seq"))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

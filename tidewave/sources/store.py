"""Tables that are built once: recordings that are finished are skipped, half-written ones are written again.

A table lies in a folder named by the digest of the settings that it was built with, so changed settings build another one. Rows
go to a folder for each recording, written over as a whole; only then is the recording entered in the manifest, and readers see
only what is entered, as it was entered last. So a build that broke off goes on with what is missing.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewave.plans.settings import digest

#: Recordings that are written and entered together.
AT_ONCE = 256
MANIFEST = "key string, version string, rows long, turn long"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fingerprint(df: DataFrame, decimals: int = 5) -> str:
    """Twelve hex digits of a table's rows in any order: the sum of their hashes, their number, and the names of the columns.

    Numbers are rounded and missing ones are alike, so machines that differ in the last place agree. It is one aggregate whose
    parts add up, so it doesn't depend on how the rows lie.
    """

    def plain(kind: str, c):
        if kind in ("double", "float"):
            return F.round(F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0)), decimals) + F.lit(0.0)
        if kind in ("array<double>", "array<float>"):
            return F.transform(c, lambda v: F.round(F.coalesce(F.nanvl(v.cast("double"), F.lit(-1.0)), F.lit(-1.0)), decimals) + F.lit(0.0))
        return c

    columns = sorted(df.dtypes)
    row = F.xxhash64(*[plain(kind, F.col(f"`{name}`")) for name, kind in columns], F.lit(1))
    other = F.xxhash64(row, F.lit(2))
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h.cast("decimal(20,0)")).alias(f"s{i}") for i, h in enumerate((row, other))]).first()
    return digest({"columns": [n for n, _ in columns], "n": sums["n"], "sums": [str(sums["s0"]), str(sums["s1"])]})


def same_or_explain(recorded: str | None, found: str, what: str) -> None:
    """Nothing if both are the same; a warning where none was recorded; else an error that says what to do."""
    if recorded == found:
        return
    if recorded is None:
        warnings.warn(f"{what} has no fingerprint; it is used as it is", stacklevel=2)
        return
    raise ValueError(f"{what} was made by code that gives other values (recorded {recorded}, now {found}); build it anew")


@dataclass(frozen=True)
class Store:
    """A table below `path` for some settings, with a folder for each value of the column `key`."""

    spark: SparkSession
    path: str
    settings: Mapping
    key: str = "recording"

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/{digest(self.settings)}"

    def manifest(self) -> DataFrame:
        """key, version, rows, turn: the last entry of each finished recording."""
        if not exists(self.spark, f"{self.folder}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        last = W.partitionBy("key").orderBy(F.desc("turn"))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Of wanted (key, version), the recordings that aren't finished in this version."""
        done = self.manifest().select(F.col("key").alias(self.key), F.col("version").alias("_done"))
        left = wanted.select(F.col(self.key).cast("string").alias(self.key), F.col("version").cast("string").alias("version")).distinct()
        return left.join(done, self.key, "left").filter(~F.col("version").eqNullSafe(F.col("_done")) | F.col("_done").isNull()).drop("_done")

    def update(self, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE) -> int:
        """Builds what is missing of wanted (key, version), AT_ONCE recordings at a time, and returns how many were built.

        build(keys) gives the rows of some recordings, with the key among their columns. A recording without rows is finished too.
        """
        keys = [(r[self.key], r["version"]) for r in self.missing(wanted).orderBy(self.key).collect()]  # names of recordings, no rows of theirs
        turn = self.manifest().agg(F.max("turn")).first()[0] or 0
        for at in range(0, len(keys), at_once):
            turn += 1
            part = self.spark.createDataFrame(keys[at : at + at_once], f"`{self.key}` string, version string")
            rows = build(part.select(self.key)).withColumn(self.key, F.col(self.key).cast("string"))
            laid = rows.repartition(self.key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key)
            laid.parquet(f"{self.folder}/data")
            written = self._data(rows.schema).join(F.broadcast(part), self.key, "left_semi").groupBy(self.key).agg(F.count(F.lit(1)).alias("rows"))
            entered = part.join(written, self.key, "left").select(
                F.col(self.key).alias("key"), "version", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(turn).cast("long").alias("turn")
            )
            entered.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return len(keys)

    def _data(self, schema: StructType | None = None) -> DataFrame:
        """All rows that lie there; the key stays text, whatever it looks like."""
        path = f"{self.folder}/data"
        found = (schema or self.spark.read.parquet(path).schema).fields
        return self.spark.read.schema(StructType([f for f in found if f.name != self.key]).add(self.key, "string")).parquet(path)

    def read(self) -> DataFrame:
        """The rows of all finished recordings."""
        done = self.manifest().filter("rows > 0").select(F.col("key").alias(self.key))
        return self._data().join(F.broadcast(done), self.key, "left_semi")


def once(spark: SparkSession, path: str, settings: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
    """A result that is built unless it is finished for these settings; a run that broke off is built again as a whole."""
    folder = f"{path.rstrip('/')}/{digest(settings)}"
    if not exists(spark, f"{folder}/result/_SUCCESS"):
        build().write.mode("overwrite").parquet(f"{folder}/result")
    return spark.read.parquet(f"{folder}/result")

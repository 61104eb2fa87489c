"""The driver's tables seen as recordings: a user's events are the epochs, an embedding is a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.arrays import doubles
from tidewave.operators.structure import keep_labelled, label

KEYS = ["user_id"]
CODES = {"click": 0, "view": 1, "purchase": 2, "signup": 3}
DROPPED = ["error"]
EDGE, WARM_UP = 5, 20
BANDS = [float("-inf"), 0.0, 3000.0, 6000.0, float("inf")]

EPOCHS_SQL = """WITH epochs AS (
  SELECT user_id, event_id, event_type, value,
         CAST(regexp_extract(props, '"k": ?([0-9.-]+)', 1) AS DOUBLE) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch_idx,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
                         WHEN 'error' THEN -1 END AS stage
  FROM events),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_idx) - 1 AS pos FROM epochs WHERE stage >= 0)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, value, k, epoch_idx (from 0 in time order), stage."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.row_number().over(w) - 1).cast("long").alias("epoch_idx"),
        label(F.col("event_type"), CODES, DROPPED).alias("stage"),
    )


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled epochs with `pos`; errors are dropped and leave gaps in epoch_idx."""
    return keep_labelled(epochs(spark, sf_dir), KEYS, "epoch_idx")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x (64 doubles)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("x"))

"""Tables that are used many times: cut from what they came from, reliably where there is a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The table as it is now, computed once: a checkpoint in spark.checkpoint.dir, or where that is unset kept by Spark, who can
    compute lost parts anew."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True) if spark.sparkContext.getCheckpointDir() else df.persist()

"""Joins, sets, checks and sinks over recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attach(df: DataFrame, info: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with the info's columns. A key that the info has twice, or misses, or with a missing value, stops the query."""
    once = info.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in columns])
    found = df.join(once, list(keys), "left")
    at = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bad = F.col("_n").isNull() | (F.col("_n") > 1)
    for c in columns:
        bad = bad | F.col(c).isNull()
    stop = F.raise_error(F.concat(F.lit("no single complete row for "), at))
    checked = [F.when(~bad, F.col(c)).otherwise(stop.cast(info.schema[c].dataType)).alias(c) for c in columns]
    return found.select(*df.columns, *checked)


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def only(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both, each once."""
    return a.intersect(b)


def no_leak(a: DataFrame, b: DataFrame, named: int = 5) -> None:
    """Two sides of a split share nothing; else this stops and names the first few that are on both."""
    both = overlap(a, b)
    found = both.orderBy(*both.columns).limit(named).collect()
    if found:
        raise ValueError("on both sides: " + ", ".join("/".join(map(str, r)) for r in found))


def pair_files(names: DataFrame, signal: str = "-PSG", labels: str = "-Hypnogram", stem: int = 7) -> DataFrame:
    """(key, signal_name, label_name, n_labels, paired) for each signal file name; paired where one label file has its stem."""
    base = names.select("name", F.substring("name", 1, stem).alias("_stem"))
    right = base.filter(F.contains("name", F.lit(labels))).groupBy("_stem").agg(F.count("*").alias("_n"), F.min("name").alias("label_name"))
    left = base.filter(F.contains("name", F.lit(signal))).withColumnRenamed("name", "signal_name")
    found = left.join(right, "_stem", "left").withColumn("n_labels", F.coalesce("_n", F.lit(0)))
    key = F.regexp_replace("signal_name", r"^(S[CT]\d{3})(\d).*$", "$1N$2")
    return found.select(key.alias("key"), "signal_name", "label_name", "n_labels", (F.col("n_labels") == 1).alias("paired"))


def paired(names: DataFrame, **columns) -> DataFrame:
    """pair_files(), but a signal file without just one label file, or of no known name, stops the query."""
    found = pair_files(names, **columns)
    known = F.regexp_like("signal_name", F.lit(r"^S[CT]\d{3}\d"))
    stop = F.when(~known, F.raise_error(F.concat(F.lit("unknown file name: "), "signal_name"))).when(
        ~F.col("paired"), F.raise_error(F.concat(F.lit("no single label file for "), "signal_name"))
    )
    return found.select(F.coalesce(stop.cast("string"), F.col("key")).alias("key"), "signal_name", "label_name")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order (an upsert's result)."""
    w = W.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows whose key isn't in new, and all of new."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def merge_manifest(new: DataFrame, old: DataFrame, key: Sequence[str], config: str, skipped: str, values: Sequence[str]) -> DataFrame:
    """new with its values; a skipped row takes those of the old row of its key if both have one config, else it has none."""
    before = old.select(*key, F.col(config).alias("_config"), *[F.col(v).alias(f"_{v}") for v in values])
    same = F.coalesce(F.col("_config") == F.col(config), F.lit(False))
    merged = {v: F.when(~F.col(skipped), F.col(v)).when(same, F.col(f"_{v}")) for v in values}
    return new.join(before, list(key), "left").withColumns(merged).select(*new.columns)


def cross_check(first: DataFrame, second: DataFrame, keys: Sequence[str], exact: Sequence[str], near: Sequence[str], most: float = 1e-3) -> DataFrame:
    """(keys, in_both, exact, near): whether two readings of each key agree, `near` columns up to `most`; nulls agree with nulls.

    A key that only one side has agrees in nothing. Both sides have a key once.
    """
    left = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in [*exact, *near]], F.lit(True).alias("_a"))
    right = second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in [*exact, *near]], F.lit(True).alias("_b"))
    in_both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    alike, close = in_both, in_both
    for c in exact:
        alike = alike & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    for c in near:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        close = close & F.coalesce(F.abs(a - b) <= most, a.isNull() & b.isNull())
    return left.join(right, list(keys), "full").select(*keys, in_both.alias("in_both"), alike.alias("exact"), close.alias("near"))


def agreement(batch: DataFrame, stream: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Compared positions of both sides: matched, mismatched and the share that agrees."""
    right = stream.select(*keys, position, F.col(value).alias("_other"))
    both = batch.join(right, [*keys, position])
    same = F.sum((F.col(value) == F.col("_other")).cast("long"))
    return both.agg(
        same.alias("matched"), (F.count("*") - same).alias("mismatched"), F.try_divide(same.cast("double"), F.count("*")).alias("agreement")
    )


def latency(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return df.agg(
        F.round(F.avg(x), 2).alias("mean"), F.round(F.percentile(x, F.lit(0.95)), 2).alias("p95"), F.round(F.max(x), 2).alias("max")
    )

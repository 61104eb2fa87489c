"""From annotations and signals to labelled, cropped epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.functions.arrays import slices

DROP = -1
WAKE = 0


def label(description: Column, codes: Mapping[str, int], dropped: Sequence[str]) -> Column:
    """A description's code, DROP for those to leave out; an unknown one stops the query, a null one stays null."""
    known = F.lit(None).cast("int")
    for text, code in codes.items():
        known = F.when(description == text, code).otherwise(known)
    known = F.when(description.isin(*dropped), DROP).otherwise(known)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), description)).cast("int")
    return F.when(description.isNull() | known.isNotNull(), known).otherwise(unknown)


def drop_counts(df: DataFrame, description: str, stage: str = "stage") -> DataFrame:
    """How many epochs are left out for each reason."""
    return df.filter(F.col(stage) == DROP).groupBy(description).agg(F.count("*").alias("n"))


def expand_intervals(df: DataFrame, keys: Sequence[str], onset: str, duration: str, epoch: float = 30.0) -> DataFrame:
    """One row per epoch of each interval, numbered from 0 along a recording; a duration that is no multiple stops it."""
    n = F.round(F.col(duration) / epoch)
    whole = F.when(F.abs(F.col(duration) - n * epoch) <= 1e-6, n.cast("int")).otherwise(
        F.raise_error(F.lit("a duration is no multiple of the epoch")).cast("int")
    )
    before = W.partitionBy(*keys).orderBy(onset).rowsBetween(W.unboundedPreceding, -1)
    counted = df.withColumn("_n", whole).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = counted.filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("epoch_idx", F.col("_start") + F.col("_i")).drop("_n", "_start", "_i")


def cut_epochs(df: DataFrame, signal: str, width: int) -> DataFrame:
    """One row per epoch of a recording's signal: epoch_idx and the slice, in place of the signal; a tail is dropped."""
    return df.select("*", F.posexplode(slices(F.col(signal), width)).alias("epoch_idx", "_epoch")).drop(signal).withColumnRenamed("_epoch", signal)


def keep_labelled(df: DataFrame, keys: Sequence[str], order: str, stage: str = "stage") -> DataFrame:
    """Rows with a stage, with their position among the kept; the order column keeps the original number.

    A table without rows gives none; require_rows() stops on it.
    """
    kept = df.filter(F.col(stage) != DROP)
    return kept.withColumn("pos", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table, which must have a row: an empty one stops with its name."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def crop_bounds(df: DataFrame, keys: Sequence[str], edge: int, stage: str = "stage") -> DataFrame:
    """Per recording n, lo and hi: from `edge` positions before the first epoch that isn't wake to as many after the last.

    All wake: everything. Positions are those of the kept epochs.
    """
    awake = F.when(F.col(stage) != WAKE, F.col("pos"))
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(awake).alias("_first"), F.max(awake).alias("_last"))
    lo = F.when(F.col("_first").isNull(), 0).otherwise(F.greatest(F.col("_first") - edge, F.lit(0)))
    hi = F.when(F.col("_first").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.col("_last") + edge + 1))
    return per.select(*keys, "n", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def crop(df: DataFrame, keys: Sequence[str], edge: int, warm_up: int) -> DataFrame:
    """The cropped rows and up to `warm_up` before them, with `warm` true for the latter.

    Filter `not warm` only after windows have seen the warm-up rows.
    """
    found = df.join(crop_bounds(df, keys, edge), list(keys))
    inside = (F.col("pos") >= F.greatest(F.col("lo") - warm_up, F.lit(0))) & (F.col("pos") < F.col("hi"))
    return found.filter(inside).withColumn("warm", F.col("pos") < F.col("lo"))


def missing_report(df: DataFrame, columns: Sequence[str], keep: Column) -> DataFrame:
    """Rows with a null among the columns: of all, of those kept, and the latter's share."""
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull().cast("int")
    kept = keep.cast("int")
    return df.agg(
        F.sum(bad).alias("rows_missing"),
        F.sum(bad * kept).alias("rows_missing_kept"),
        F.try_divide(F.sum(bad * kept).cast("double"), F.sum(kept)).alias("ratio"),
    )


def sequence_windows(df: DataFrame, keys: Sequence[str], length: int, stride: int) -> DataFrame:
    """One row per (window, member): start, pos and whether this window scores the position.

    Each position of a recording with `length` rows or more is scored once: a window scores its middle part, the first
    and last also their outer ends. df has `pos` from 0.
    """
    per = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= length)
    last = F.col("_n") - length
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last)))
    per = per.withColumn("_starts", F.array_sort(starts)).select("*", F.posexplode("_starts").alias("_w", "start"))
    margin = (length - stride) // 2
    previous = F.get("_starts", F.col("_w") - 1)
    low = F.when(F.col("_w") == 0, 0).otherwise(previous + margin + stride)
    high = F.when(F.col("start") == last, F.col("_n")).otherwise(F.col("start") + margin + stride)
    rows = per.withColumn("_low", low).withColumn("_high", high)
    rows = rows.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)))
    scored = (F.col("pos") >= F.col("_low")) & (F.col("pos") < F.col("_high"))
    return rows.select(*keys, "start", "pos", scored.alias("scored"))


def count_runs(df: DataFrame, keys: Sequence[str], order: str, above: Column, shortest: int, longest: int) -> DataFrame:
    """Per key: how many runs of consecutive true rows have a length between the bounds, and their rows together."""
    w = W.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, "_above").orderBy(order))
    marked = df.select(*keys, order, above.alias("_above")).withColumn("_island", island).filter("_above")
    runs = marked.groupBy(*keys, "_island").agg(F.count("*").alias("_len"))
    fits = F.col("_len").between(shortest, longest)
    counts = runs.groupBy(*keys).agg(
        F.sum(fits.cast("long")).alias("n_runs"), F.sum(F.when(fits, F.col("_len")).otherwise(0)).alias("run_rows")
    )
    every = df.select(*keys).distinct().join(counts, list(keys), "left")
    return every.select(*keys, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("run_rows", F.lit(0)).alias("run_rows"))


def align_lengths(annotated: DataFrame, recorded: DataFrame, keys: Sequence[str], order: str = "epoch_idx") -> DataFrame:
    """Epochs that both the annotations and the signal have, with the columns of both: whichever goes on longer is cut."""
    return annotated.join(recorded, [*keys, order])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value (null or nan) among the columns."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df

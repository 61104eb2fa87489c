"""Recording quality from the epochs' peak-to-peak values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT_BELOW = 20.0
TOO_FLAT = 0.20


def flat_fraction(df: DataFrame, keys: Sequence[str], channel: str, ptp: str, below: float = FLAT_BELOW) -> DataFrame:
    """Per recording and channel the share of epochs under the threshold."""
    share = F.avg(F.when(F.col(ptp) < below, 1.0).otherwise(0.0))
    return df.groupBy(*keys, channel).agg(F.count("*").alias("n_epochs"), share.alias("flat_fraction"))


def verdict(fractions: DataFrame, keys: Sequence[str], channel: str, limit: float = TOO_FLAT) -> DataFrame:
    """Per recording: excluded if any channel is flat too often, and which ones are."""
    bad = F.col("flat_fraction") > limit
    named = F.array_sort(F.collect_set(F.when(bad, F.col(channel))))
    return fractions.groupBy(*keys).agg(
        F.bool_or(bad).alias("excluded"), F.array_join(named, ",").alias("bad_channels"), F.max("flat_fraction").alias("worst")
    )


#: Checks by name: from a channel's epochs an aggregate that is true where the channel is bad.
CHECKS: dict[str, Callable[[Column, float, float], Column]] = {
    "flat": lambda ptp, below, limit: F.avg(F.when(ptp < below, 1.0).otherwise(0.0)) > limit,
}


def assess(df: DataFrame, keys: Sequence[str], channel: str, ptp: str, checks: Sequence[str] = ("flat",), below: float = FLAT_BELOW, limit: float = TOO_FLAT) -> DataFrame:
    """Per recording: excluded if a channel fails any of the named checks, and `reasons`, check:channel by commas. An unknown check stops."""
    if unknown := [c for c in checks if c not in CHECKS]:
        raise KeyError(f"unknown checks {', '.join(unknown)}; known: {', '.join(sorted(CHECKS))}")
    bad = df.groupBy(*keys, channel).agg(*[CHECKS[c](F.col(ptp), below, limit).alias(f"_{c}") for c in checks])
    told = F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.concat(F.lit(f"{c}:"), F.col(channel))) for c in checks]))
    found = bad.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(told))).alias("_r"))
    return found.select(*keys, (F.size("_r") > 0).alias("excluded"), F.array_join("_r", ",").alias("reasons"))


def worst(verdicts: DataFrame, keys: Sequence[str], n: int = 12) -> DataFrame:
    """The n recordings with the flattest channel, for a report."""
    return verdicts.orderBy(F.desc("worst"), *keys).limit(n)


def scan(df: DataFrame, keys: Sequence[str], channel: str, ptp: str, config: str, below: float = FLAT_BELOW, limit: float = TOO_FLAT) -> dict:
    """A report over all recordings: how many, how many are excluded, with how many epochs, and by which settings made.

    df has the epochs that count (inside the crop), one row per epoch and channel. No epochs, or epochs of different settings,
    stop it. The driver sees one row for each excluded recording.
    """
    made = [r[0] for r in df.select(config).distinct().limit(2).collect()]
    if not made:
        raise ValueError("no epochs to look at")
    if len(made) > 1:
        raise ValueError(f"epochs of different settings: {', '.join(sorted(map(str, made)))}")
    fractions = flat_fraction(df, keys, channel, ptp, below)
    epochs = fractions.groupBy(*keys).agg(F.max("n_epochs").alias("n_epochs"))
    found = verdict(fractions, keys, channel, limit).join(epochs, list(keys))
    bad = found.filter("excluded").orderBy(*keys).select(*keys, "bad_channels", "n_epochs").collect()
    return {
        "below": below,
        "limit": limit,
        "config": made[0],
        "n_recordings": found.count(),
        "n_excluded": len(bad),
        "n_epochs_excluded": sum(r["n_epochs"] for r in bad),
        "excluded": [[r[k] for k in keys] for r in bad],
    }


def excluded(report: dict, config: str) -> list[tuple]:
    """The excluded recordings of a report, which must have been made of epochs with these settings."""
    if report["config"] != config:
        raise ValueError(f"the report is of settings {report['config']}, the epochs are of {config}: scan them again")
    return [tuple(k) for k in report["excluded"]]

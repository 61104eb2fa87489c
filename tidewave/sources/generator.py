"""Recordings made by rule, for trying out settings without data: sums of sinusoids and noise, in expressions over spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the made signal: (microvolts, Hz) that are always there, and the burst with the rhythm that lets it through.
TONES = ((40.0, 1.0), (15.0, 6.0), (5.0, 22.0))
BURST, GATE, GATE_LEVEL = (10.0, 13.0), 0.05, 0.6
NOISE = 4.0
SHARES = (1.0, 0.6)  # of the tones in each channel


def _uniform(*parts: Column) -> Column:
    """A number inside (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def _tone(level: float, hertz: float, t: Column) -> Column:
    return F.sin(t * (2 * math.pi * hertz)) * level


def recordings(spark: SparkSession, n: int, epochs: int, rate: float = 100.0, epoch_seconds: float = 30.0, seed: int = 0) -> DataFrame:
    """recording, epoch_idx, signal ([channel][sample] in microvolts) of n recordings, which differ by their noise alone.

    A sample follows from the seed, recording, channel and time alone, however the rows are dealt.
    """
    width = int(round(rate * epoch_seconds))
    rows = spark.range(n * epochs).select(F.floor(F.col("id") / epochs).alias("recording"), (F.col("id") % epochs).alias("epoch_idx"))

    def channel(number: int, share: float) -> Column:
        def sample(i: Column) -> Column:
            at = F.col("epoch_idx") * width + i
            t = at / rate
            gate = F.when(F.sin(t * (2 * math.pi * GATE)) > GATE_LEVEL, F.lit(1.0)).otherwise(F.lit(0.0))
            base = sum((_tone(*x, t) for x in TONES), _tone(*BURST, t) * gate)
            key = (F.lit(seed), F.col("recording"), F.lit(number), at)
            normal = F.sqrt(-2 * F.log(_uniform(*key, F.lit(1)))) * F.cos(_uniform(*key, F.lit(2)) * (2 * math.pi))
            return base * share + normal * NOISE

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), sample)

    return rows.select("recording", "epoch_idx", F.array(*[channel(i, s) for i, s in enumerate(SHARES)]).alias("signal"))

"""Columns over one epoch's signal: an array of doubles. All are expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def moments(a: Column) -> Column:
    """A struct of the central moments m2, m3 and m4 over all values: one pass for the mean, one for the rest."""

    def around(a: Column, m: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("m2"), F.lit(0.0).alias("m3"), F.lit(0.0).alias("m4"))

        def add(s: Column, x: Column) -> Column:
            d = x - m
            return F.struct((s["m2"] + d * d).alias("m2"), (s["m3"] + d * d * d).alias("m3"), (s["m4"] + d * d * d * d).alias("m4"))

        n = F.size(a)
        return F.aggregate(a, start, add, lambda s: F.struct(*[F.try_divide(s[k], n).alias(k) for k in ("m2", "m3", "m4")]))

    return bind(a, lambda v: bind(mean(v), lambda m: around(v, m)))


def variance(a: Column) -> Column:
    return bind(a, lambda v: bind(mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m), lambda s: F.try_divide(s, F.size(v)))))


def diff(a: Column) -> Column:
    return bind(a, lambda v: F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda x, y: x - y))


def _at(ordered: Column, q: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def quantile(a: Column, q: float) -> Column:
    """Linear between the two nearest values."""
    return bind(F.sort_array(a), lambda s: _at(s, q))


def sign_changes(a: Column) -> Column:
    """How often the sign bit changes from one sample to the next."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("boolean").alias("was"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["n"] + F.when(s["was"] != (x < 0), 1).otherwise(0)).alias("n"), (x < 0).alias("was"))

    return F.aggregate(a, start, step, lambda s: s["n"])


def statistics(a: Column) -> Column:
    """A struct of std, iqr, skew, kurt (excess) and nzc; moments over all values."""

    def found(v: Column, m: Column, s: Column) -> Column:
        return F.struct(
            F.sqrt(m["m2"]).alias("std"),
            (_at(s, 0.75) - _at(s, 0.25)).alias("iqr"),
            F.try_divide(m["m3"], F.pow(m["m2"], F.lit(1.5))).alias("skew"),
            (F.try_divide(m["m4"], m["m2"] * m["m2"]) - 3).alias("kurt"),
            sign_changes(v).alias("nzc"),
        )

    return bind(a, lambda v: bind(moments(v), lambda m: bind(F.sort_array(v), lambda s: found(v, m, s))))


def hjorth(a: Column) -> Column:
    """A struct of mobility and complexity."""

    def found(v0: Column, v1: Column, v2: Column) -> Column:
        mobility = F.sqrt(F.try_divide(v1, v0))
        return F.struct(mobility.alias("mobility"), F.try_divide(F.sqrt(F.try_divide(v2, v1)), mobility).alias("complexity"))

    three = lambda v, d: F.array(variance(v), variance(d), variance(diff(d)))
    return bind(a, lambda v: bind(bind(diff(v), lambda d: three(v, d)), lambda m: found(m[0], m[1], m[2])))


def max_min_distance(a: Column, width: int) -> Column:
    """Over whole windows of `width` samples, the sum of the distances between the first maximum and the first minimum."""
    starts = F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1)

    def one(w: Column) -> Column:
        def distance(part: Column) -> Column:
            high, low = F.array_max(part), F.array_min(part)
            return F.hypot(high - low, (F.array_position(part, high) - F.array_position(part, low)).cast("double"))

        return bind(F.slice(a, w * width + 1, F.lit(width)), distance)

    return total(F.transform(starts, one))


def energy_product(a: Column) -> Column:
    """The sum of squares times the sum of squared differences."""
    square = lambda b: total(F.transform(b, lambda x: x * x))
    return square(a) * square(diff(a))


def petrosian(a: Column) -> Column:
    """Petrosian's fractal dimension, from the sign changes of the differences."""
    n, changes = F.size(a).cast("double"), sign_changes(diff(a))
    return F.log10(n) / (F.log10(n) + F.log10(n / (n + changes * 0.4)))


def quality(a: Column) -> Column:
    """A struct of ptp, std and flat_ratio, the share of samples equal to the one before."""

    def found(v: Column) -> Column:
        flat = F.aggregate(diff(v), F.lit(0.0), lambda s, d: s + F.when(d == 0, 1.0).otherwise(0.0))
        return F.struct(
            (F.array_max(v) - F.array_min(v)).alias("ptp"), F.sqrt(variance(v)).alias("std"), F.try_divide(flat, F.size(v) - 1).alias("flat_ratio")
        )

    return bind(a, found)


def band_power(freqs: Column, psd: Column, low: float, high: float) -> Column:
    """Rectangle rule over low <= f < high, evenly spaced frequencies."""
    step = F.get(freqs, F.lit(1)) - F.get(freqs, F.lit(0))
    inside = F.zip_with(freqs, psd, lambda f, p: F.when((f >= low) & (f < high), p).otherwise(0.0))
    return total(inside) * step


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, null where either side doesn't vary."""

    def around(p: Column, ma: Column, mb: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("aa", "bb", "ab")])

        def add(s: Column, x: Column) -> Column:
            u, v = x["u"] - ma, x["v"] - mb
            return F.struct((s["aa"] + u * u).alias("aa"), (s["bb"] + v * v).alias("bb"), (s["ab"] + u * v).alias("ab"))

        return F.aggregate(p, start, add, lambda s: F.try_divide(s["ab"], F.sqrt(s["aa"] * s["bb"])))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("u"), y.alias("v")))
    middle = lambda p, k: mean(F.transform(p, lambda x: x[k]))
    return bind(pairs, lambda p: bind(F.array(middle(p, "u"), middle(p, "v")), lambda m: around(p, m[0], m[1])))


def slices(a: Column, width: int) -> Column:
    """Whole windows of `width` samples; what remains at the end is dropped."""
    n = F.floor(F.size(a) / width).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.slice(a, i * width + 1, F.lit(width)))


def first_max(a: Column) -> Column:
    """The position (from 0) of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    return bind(F.array_max(a), lambda top: top + F.ln(total(F.transform(a, lambda x: F.exp(x - top)))))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words from its weight. Whole epochs come first: every document of the source is taken so
many times. What remains of the target is filled by a weighted sample without replacement: a document's key is an
exponential draw divided by its quality weight, documents go in the order of their keys, and a prefix sum of their sizes
finds where the budget ends.

Nothing sorts a source as a whole. Keys map to (0, 1) in order; that range is cut into buckets, whose sizes are summed
before anything is shuffled. Only the one bucket in which a source's budget ends is put in order, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import local_rows, materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 1024
#: The plan of the sources is broadcast up to so many of them, and joined by a shuffle beyond.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: less for a larger share of symbols and digits among the characters."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "#*$%&|<>0123456789", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(2.0) * odd / F.greatest(F.length(text), F.lit(1)))


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = MAX_EPOCHS) -> list[float]:
    """Targets that share `total` by weight, none above `most` times its size; the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0]
    left = float(total)
    while free:
        share = left / math.fsum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in over]
    return targets


def _uniform(doc_id: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """A row's id, source, size, hash, key and bucket, as a struct."""
    text, quality = F.col(text_col), quality_weight(F.col(text_col))
    key = -F.ln(_uniform(F.col(id_col).cast("long"), seed)) / quality
    return F.struct(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(text).alias("size"),
        key.alias("key"),
        F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS).cast("int").alias("bucket"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("crc"),
    )


def _meet(left: DataFrame, right: DataFrame, broadcast: bool) -> DataFrame:
    """Join by source, nulls equal."""
    right = right.withColumnRenamed("source", "_s")
    right = F.broadcast(right) if broadcast else right
    return left.join(right, F.col("_row.source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(rows: DataFrame, weights=WEIGHTS) -> tuple[DataFrame, bool]:
    """Per source of rows (a struct _row each): source_size, target, _epochs, and up to where the sample goes, the bucket
    _end and in it the last row _bound; and whether the plan is small enough to be broadcast.

    The driver sees one row a source.
    """
    spark = rows.sparkSession
    sums = materialize(rows.groupBy(F.col("_row.source").alias("source"), F.col("_row.bucket").alias("_end")).agg(F.sum("_row.size").alias("_sum")))
    per = sums.groupBy("source").agg(F.sum("_sum").alias("n")).collect()
    per = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in per]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(per))], sum(sizes))
    out = []
    for r, target in zip(per, targets, strict=True):
        epochs = min(MAX_EPOCHS, int(target // r["n"])) if r["n"] else 0
        out.append((r["source"], r["n"], target, epochs, target - epochs * r["n"]))
    small = len(out) <= BROADCAST_SOURCES
    budgets = local_rows(spark, out, "source string, source_size long, target double, _epochs long, _left double")
    before = W.partitionBy("source").orderBy("_end").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    # The bucket where the budget ends: it begins below the budget and ends at or above it.
    offsets = offsets.select(F.struct("source").alias("_row"), "_end", "_sum", "_offset")
    ends = _meet(offsets, budgets.select("source", "_left"), small)
    ends = ends.filter((F.col("_offset") < F.col("_left")) & (F.col("_offset") + F.col("_sum") >= F.col("_left")))
    ends = materialize(ends.select(F.col("_row.source").alias("source"), "_end", "_offset", "_left"))
    inside = W.partitionBy("_row.source").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    edge = _meet(rows, ends, small).filter(F.col("_row.bucket") == F.col("_end"))
    edge = edge.withColumn("_used", F.col("_offset") + F.coalesce(F.sum("_row.size").over(inside), F.lit(0)))
    # A row is in if that brings its source nearer to the budget: true of the first ones, and then of no more.
    edge = edge.filter(F.col("_used") + F.col("_row.size") / 2 <= F.col("_left"))
    bounds = edge.groupBy(F.col("_row.source").alias("_b")).agg(F.max(F.struct(*_ORDER)).alias("_bound"))
    named = budgets.drop("_left").join(ends.select(F.col("source").alias("_e"), "_end"), F.col("source").eqNullSafe(F.col("_e")), "left")
    named = named.join(bounds, F.col("source").eqNullSafe(F.col("_b")), "left").drop("_e", "_b")
    return materialize(named), small


_ORDER = ("_row.key", "_row.doc_id", "_row.crc", "_row.size")


def _copies() -> Column:
    sampled = (F.col("_row.bucket") < F.col("_end")) | (
        (F.col("_row.bucket") == F.col("_end")) & (F.struct(*_ORDER) <= F.col("_bound"))
    )
    return F.col("_epochs") + F.coalesce(sampled.cast("long"), F.lit(0))


def mix(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, seed: int = 0
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    Sources in code point order, null last, weigh `weights`, over and over; together they take as many words as there are.
    taken is size times copies. Within a source, what is taken differs from the target by half the size of one document at
    most (and a rounding). Null texts have no words; null ids and sources are values like others; repeated rows share a
    key, and all of them are taken or none in the sample; an empty table gives no rows; reruns agree.
    """
    rows = materialize(docs.select(_drawn(docs, id_col, text_col, source_col, seed).alias("_row")))
    told = _meet(rows, *plan(rows, weights)).withColumn("copies", _copies())
    taken = (F.col("_row.size") * F.col("copies")).alias("taken")
    return told.select("_row.doc_id", "_row.size", "source_size", "target", taken, "copies")


def apply(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, seed: int = 0
) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken. Texts aren't shuffled."""
    drawn = _drawn(docs, id_col, text_col, source_col, seed)
    rows = materialize(docs.select(drawn.alias("_row")))
    told = _meet(docs.select(F.struct("*").alias("_doc"), drawn.alias("_row")), *plan(rows, weights))
    repeated = told.select("_doc", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("_copy"))
    return repeated.select("_doc.*")

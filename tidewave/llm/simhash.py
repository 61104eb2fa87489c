"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments, each with a table of the fingerprints by that segment's value. Two fingerprints
within max_distance bits are close in some segment: with m segments and max_distance = m * r + a, one of the first a + 1
is within r bits or one of the others within r - 1. So each fingerprint enumerates the Hamming ball of that radius in each
segment, fetches what the tables hold there, and every match is verified by its complete distance. Of two values one bit
apart only the lesser enumerates the greater, which finds the pair once.

Near copies may crowd a table's bucket. Buckets of more than CROWDED fingerprints are split by all other bits: whoever is in
one or fetches one is filed under each whole fingerprint within one bit, where any two within two bits meet and no more
than 65 can be. So work grows with the number of fingerprints, not with the square of a group, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import BROADCAST_ROWS, join_hot, keep_rows, materialize, text_node
from .components import components
from .shingles import BITS, SHINGLE, fingerprint_of

MAX_DISTANCE = 2
SEGMENTS = 2
CROWDED = 64


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long. Lower-cases A-Z only; words are runs of bytes outside \\x20 and \\x09-\\x0D."""

    def found(texts: pa.Array) -> pa.Array:
        prints = (fingerprint_of((t.as_py() or b"").lower().split(), shingle) for t in texts)
        return pa.array(np.fromiter(prints, np.uint64, len(texts)).view(np.int64))

    return F.arrow_udf(found, "long")(text.cast("binary"))


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _long(value: int) -> Column:
    return F.lit(int(np.uint64(value).astype(np.int64))).cast("long")


def radii(max_distance: int, segments: int) -> list[int]:
    """The radius of the ball in each segment; -1 where a segment need not be looked up."""
    r, a = divmod(max_distance, segments)
    return [r if i <= a else r - 1 for i in range(segments)]


def _values(max_distance: int, segments: int, ball: bool) -> Column:
    """(segment, value) of a `node`: its own, or with `ball` also those within the radius that have one bit more set."""
    cuts, out = [BITS * i // segments for i in range(segments + 1)], []
    for i, radius in enumerate(radii(max_distance, segments)):
        if radius >= 0:
            width = cuts[i + 1] - cuts[i]
            value = F.shiftrightunsigned("node", cuts[i]).bitwiseAND(_long((1 << width) - 1))
            keys = [value]
            if radius and ball:
                keys += [F.when(value.bitwiseAND(_long(1 << j)) == 0, value.bitwiseOR(_long(1 << j))) for j in range(width)]
            out += [F.when(k.isNotNull(), F.struct(F.lit(i).alias("segment"), k.alias("value"))) for k in keys]
    return F.explode(F.array_compact(F.array(*out)))


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """(a, b), a < b: pairs of fingerprints at up to max_distance (0, 1 or 2) bits, which link all that lie so close.

    prints has distinct `node`s. Every link between members of buckets that aren't crowded is returned. In a crowded one, for
    distance 2, those from each whole-fingerprint key's smallest member, through which the others are linked. An empty table
    gives no links. Segments need a radius of one bit or less, so two bits take at least two of them.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if not 1 <= segments <= BITS or max(radii(max_distance, segments)) > 1:
        raise ValueError(f"{segments} segments are too few or too many for distance {max_distance}")
    if not max_distance:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("false")
    key = ["segment", "value"]
    filed = prints.select("node", _values(max_distance, segments, False).alias("_k")).select("node", "_k.*")
    asked = prints.select("node", _values(max_distance, segments, True).alias("_k")).select("node", "_k.*")
    full = materialize(filed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select(*key))
    many = full.count()
    hot = None
    if many:
        near = F.broadcast(full) if many <= BROADCAST_ROWS else full
        hot = filed.join(near, key, "left_semi").select("node").union(asked.join(near, key, "left_semi").select("node")).distinct()
        filed = filed.join(near, key, "left_anti")
    met = asked.withColumnRenamed("node", "_x").join(filed.withColumnRenamed("node", "_y"), key)
    found = _close(met, max_distance)
    return (found if hot is None else found.union(_close(_met_whole(hot, max_distance), max_distance))).distinct()


def _close(met: DataFrame, max_distance: int) -> DataFrame:
    near = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))).between(1, max_distance)
    return met.filter(near).select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def _met_whole(nodes: DataFrame, max_distance: int) -> DataFrame:
    """(_x, _y): pairs of nodes that link all within max_distance bits, by keys of all bits."""
    flips = F.explode(F.array(*[_long(0), *(_long(1 << i) for i in range(BITS))])).alias("_flip")
    ball = nodes.select("node", flips).select("node", F.col("node").bitwiseXOR(F.col("_flip")).alias("_key"))
    if max_distance == 1:
        return ball.select(F.col("node").alias("_x"), F.col("_key").alias("_y")).join(nodes.select(F.col("node").alias("_y")), "_y")
    first = ball.groupBy("_key").agg(F.min("node").alias("_x"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return ball.select("_key", F.col("node").alias("_y")).join(first.select("_key", "_x"), "_key")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of max_distance bits or fewer, itself included. Null and
    empty texts have fingerprint zero and link like any other; null ids never name a component unless it has no other
    (then it is null); repeated rows are returned as often as they come; an empty table gives no rows; further columns
    are ignored.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("_print")))
    classes = materialize(rows.groupBy(F.col("_print").alias("node")).agg(F.min("doc_id").alias("_first")))
    heads = print_heads(classes, max_distance, segments)
    return join_hot(rows, heads, "_print").select("doc_id", hex16(F.col("_print")).alias("fingerprint"), F.col("_first").alias("component_id"))


def print_heads(classes: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(_print, _first): for each distinct fingerprint `node` the least `_first` of its component."""
    labels = components(classes.select("node"), links(classes.select("node"), max_distance, segments))
    joined = materialize(labels.join(classes, "node"))
    heads = joined.groupBy("label").agg(F.min("_first").alias("_least"))
    return join_hot(joined, heads, "label").select(F.col("node").alias("_print"), F.col("_least").alias("_first"))


def keep_first(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float | None = None,
    max_distance: int = MAX_DISTANCE,
    segments: int = SEGMENTS,
) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, with the columns of docs.

    Without a similarity, groups are the components over fingerprints at max_distance bits or fewer. With one, they are those
    over pairs of texts whose sets of shingles have at least this Jaccard similarity. What multi-index hashing finds near by
    fingerprints of these sets is verified by the whole sets and becomes one group; between different groups `overlap` finds every
    other pair, as fingerprints of texts that are as similar as asked may lie too far apart for any small ball.

    A null id stays only where its group has no other. Of rows with one id in a group the text with the smallest hash stays;
    rows with one id, or none, and texts of different groups stay each in its own. Null, empty and blank texts are alike;
    an empty table stays empty.
    """
    if shingle < 1 or similarity is not None and not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1, shingle at least 1")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    if similarity is None:
        rows = materialize(texts.select("_id", text_node(F.col("_text")).alias("_hash"), fingerprint(F.col("_text"), shingle).alias("node")))
        nodes = materialize(rows.select("node").distinct())
        labels = components(nodes, links(nodes, max_distance, segments))
    else:
        found = overlap.Texts(texts, shingle, similarity, prints=True)
        rows, labels = found.rows, found.labels(_proposed(found.classes, max_distance, segments))
    best = F.min(F.struct(F.col("_id").isNull(), "_id", "_hash"))
    classes = rows.groupBy("node").agg(best.alias("_h"))
    heads = labels.join(classes, "node").groupBy("label").agg(F.min("_h").alias("_h"))
    return keep_rows(docs, rows, heads.select("_h._id", "_h._hash"), id_col, text_col)


def _proposed(classes: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(a, b), a < b: each class with the first of its fingerprint, and those first ones of each fingerprint and the least that
    it is linked to. So there are two pairs a class at most, however large a group is."""
    prints = materialize(classes.groupBy("print").agg(F.min("node").alias("_rep")))
    alike = join_hot(classes.select("node", "print"), prints, "print").select(F.col("_rep").alias("a"), F.col("node").alias("b"))
    near = links(prints.select(F.col("print").alias("node")), max_distance, segments).groupBy("b").agg(F.min("a").alias("a"))
    for x in "ab":
        near = near.join(prints.select(F.col("print").alias(x), F.col("_rep").alias(f"_{x}")), x)
    near = near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return alike.filter("a < b").union(near)

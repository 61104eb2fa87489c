"""Sharding by a hierarchical weighted hash tree.

A topology is region -> rack -> shard, each shard with a weight; a node weighs what its shards weigh together. A row
descends from the root: at each level every child draws -ln(u) / weight, with u a hash of (key, child), and the smallest
draw wins, so a child wins in proportion to its weight. A child's draw depends on its own name and weight alone. Hence
raising one weight moves rows only into the subtrees on the path to that shard, lowering one only out of them, and rows
whose winners did not change stay where they are.

Growth adds a region of its own with one rack and one shard: no existing weight changes, so that the only moves are into
the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import add_crc32, materialize

#: Rows of one (shard, bucket) group, which one task numbers; buckets are added with the table.
ROWS_PER_BUCKET = 200_000
#: Shards that a cluster begins with, in full racks; a smaller cluster begins with what it has.
BASE = 16


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(n_shards: int, base: int = BASE, shards_per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """The first `base` shards in full racks and regions; each later one in a region of its own."""
    out = []
    for s in range(n_shards):
        rack = s // shards_per_rack
        inside = s < base
        region = f"g{rack // racks_per_region}" if inside else f"x{s}"
        out.append(Shard(s, region, f"{region}/k{rack}" if inside else f"{region}/k0"))
    return out


def _children(shards: Sequence[Shard]) -> dict[str, dict[str, float]]:
    tree: dict[str, dict[str, float]] = {}
    for s in shards:
        if s.weight <= 0:
            continue
        for parent, child in (("", s.region), (s.region, s.rack), (s.rack, f"s{s.number}")):
            below = tree.setdefault(parent, {})
            below[child] = below.get(child, 0.0) + s.weight
    return tree


def _uniform(key: Column, child: Column) -> Column:
    """A hash of (key, child) as a number inside (0, 1), of 52 bits."""
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), child)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def place(key: Column, shards: Sequence[Shard]) -> Column:
    """The shard number of a string key. Only the children on the row's own path draw."""
    tree = _children(shards)
    if not tree:
        raise ValueError("no shard has a weight")
    nodes = F.create_map(
        *[
            x
            for parent, below in tree.items()
            for x in (
                F.lit(parent),
                F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in below.items()]),
            )
        ]
    )
    at = F.lit("")
    for _ in range(3):
        draws = F.transform(
            F.element_at(nodes, at),
            lambda c: F.struct((-F.ln(_uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")),
        )
        at = F.array_min(draws)["name"]
    return F.substring(at, 2, 10).cast("int")


def assign(
    docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", grow: bool = True
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1. The law is `key`: id and shard count alone decide the shard. slot numbers the
    rows of a shard from 0 without gaps in the order of the id's MD5, then of the id and text. grown_shard is the shard
    with one shard more. A null text counts as empty, a null id has the key "null", repeated rows share a shard and get
    slots of their own, an empty table gives no rows, and further columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    base = min(BASE, n_shards)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        add_crc32(F.col(text_col)).alias("text_crc32"),
        F.md5(key).alias("_order"),
        place(key, topology(n_shards, base)).alias("shard"),
        (place(key, topology(n_shards + 1, base)) if grow else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = materialize(rows)
    digits = 1
    total = rows.count()
    while total > ROWS_PER_BUCKET * n_shards * 16**digits:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_order", 1, digits))
    return _slots(rows, digits).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _slots(rows: DataFrame, digits: int) -> DataFrame:
    """Number each shard's rows by _order: a bucket is a prefix of it, so bucket offsets plus ranks inside are the slots."""
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("shard", "_bucket").orderBy("_order", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "_bucket"]).withColumn("slot", F.col("_rank") + F.col("_offset"))

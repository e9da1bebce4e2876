"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; each node's weight is the sum of the
shards' weights below it. A key descends level by level: every child of the
node reached draws -ln(u) / weight, u being a hash of key and child, and the
smallest draw wins (weighted rendezvous). A child's draw depends on nothing
but the key and the child's own weight, so a change of weight moves keys only
into or out of the subtrees whose weights changed. Growth appends a region of
its own, which leaves all other weights as they were: keys move only into it.

Edge cases: a null key is placed by the text's crc32; equal keys share a
shard; a null text has size 16 and crc32 0; an empty table gives no rows; the
result has the named columns only, so clashing extra columns cannot interfere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Bytes that every row counts besides its text.
ROW_BYTES = 16
#: Slices of each shard in which slots are numbered independently.
SLICES = 256


@dataclass(frozen=True)
class ShardTree:
    """Parallel lists over nodes, root first; children of a node stand together."""

    first: tuple[int, ...]
    count: tuple[int, ...]
    weight: tuple[float, ...]
    key: tuple[int, ...]
    leaf: tuple[int, ...]


def shard_tree(shards: int, base: int = 40, per_rack: int = 4, per_region: int = 16, weights: dict[int, float] | None = None) -> ShardTree:
    """The tree of shards 0 to shards - 1. The first `base` fill racks and regions; each later one is a region of its own."""
    if shards < 1:
        raise ValueError("a tree needs one shard at least")
    weights = weights or {}
    planned = min(shards, base)
    regions = [
        [list(range(k, min(k + per_rack, r + per_region, planned))) for k in range(r, min(r + per_region, planned), per_rack)]
        for r in range(0, planned, per_region)
    ]
    regions += [[[s]] for s in range(planned, shards)]
    weigh = lambda ids: float(sum(weights.get(s, 1.0) for s in ids))
    racks = [rack for region in regions for rack in region]
    n_regions, n_racks = len(regions), len(racks)
    first, count, weight, key, leaf = [1], [n_regions], [weigh(range(shards))], [0], [-1]
    at = 1 + n_regions
    # A node's key must not change as the tree grows: racks and regions are named by their first shard.
    for region in regions:
        first.append(at), count.append(len(region)), leaf.append(-1)
        weight.append(weigh(s for rack in region for s in rack)), key.append(1_000_000_000 + region[0][0])
        at += len(region)
    at = 1 + n_regions + n_racks
    for rack in racks:
        first.append(at), count.append(len(rack)), leaf.append(-1)
        weight.append(weigh(rack)), key.append(2_000_000_000 + rack[0])
        at += len(rack)
    for rack in racks:
        for s in rack:
            first.append(0), count.append(0), leaf.append(s), weight.append(weigh([s])), key.append(3_000_000_000 + s)
    return ShardTree(tuple(first), tuple(count), tuple(weight), tuple(key), tuple(leaf))


def _at(values, index: Column, kind: str) -> Column:
    return F.element_at(F.lit(list(values)).cast(f"array<{kind}>"), index + 1)


def _draw(tree: ShardTree, key: Column, node: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, _at(tree.key, node, "bigint")), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / _at(tree.weight, node, "double")


def descend(df: DataFrame, tree: ShardTree, key: str, out: str) -> DataFrame:
    """df with `out`, the shard that `key` reaches, and `out`_region and `out`_rack, the first shards of the nodes passed."""
    node = F.lit(0)
    for level in ("region", "rack", "shard"):
        children = F.sequence(_at(tree.first, node, "int"), _at(tree.first, node, "int") + _at(tree.count, node, "int") - 1)
        best = F.array_min(F.transform(children, lambda c: F.struct(_draw(tree, F.col(key), c).alias("draw"), c.alias("node"))))
        df = df.withColumn(f"__{level}", best["node"])
        node = F.col(f"__{level}")
    return df.withColumns({
        f"{out}_region": (_at(tree.key, F.col("__region"), "bigint") - 1_000_000_000).cast("int"),
        f"{out}_rack": (_at(tree.key, F.col("__rack"), "bigint") - 2_000_000_000).cast("int"),
        out: _at(tree.leaf, F.col("__shard"), "int"),
    }).drop("__region", "__rack", "__shard")


def shard_documents(docs: DataFrame, shards: int = 40, slices: int = SLICES) -> DataFrame:
    """One row per document: size, crc32, shard, gapless slot within the shard, and the shard if there were one more.

    Slots are numbered in hash slices of a shard, each shifted by the rows of the
    slices before it: no task ever holds a whole shard, and the only broadcast has
    shards * slices rows at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    ).withColumn("__key", F.coalesce("doc_id", -1 - F.col("text_crc32")))
    placed = descend(narrow, shard_tree(shards), "__key", "shard")
    placed = descend(placed, shard_tree(shards + 1, base=min(shards, 40)), "__key", "grown_shard")
    placed = placed.withColumn("__slice", F.pmod(F.xxhash64("__key", "text_crc32"), F.lit(slices)).cast("int"))
    placed = staged(placed.drop("__key", "grown_shard_region", "grown_shard_rack"), "placed")

    before = W.partitionBy("shard").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "__slice").agg(F.count("*").alias("__n"))
        .select("shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = W.partitionBy("shard", "__slice").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        placed.withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "__slice"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("__before") + F.col("__rank")).cast("long").alias("slot"), "grown_shard",
            F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"),
        )
    )

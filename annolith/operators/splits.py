"""Deterministic splits: stratified by position, grouped by hash edges, frozen manifests, and the leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.hashing import cumulative_edges, hash_score, split_of
from ..session import BROADCAST_BYTES, staged


#: Equal parts of the hash scores; the one that holds a cut of a stratum is looked into.
SLICES = 4096


def stratified_split(df: DataFrame, key: str, strata: list[str], seed: int = V.SPLIT_SEED, weights: dict[str, float] | None = None) -> DataFrame:
    """df with `split`: within each stratum by hash score, cut at the cumulative shares, half-even rounding. Keys must be unique.

    Only the two rows at which a stratum is cut are sought: rows are counted by stratum and slice of the scores, and the slices
    that hold a cut are ranked. Every row then decides by its own score on the scan, so that no column but the key and the strata is ever written or shuffled.
    """
    weights = weights or V.SYNTHETIC_WEIGHTS
    total = sum(weights.values())
    first, second = (weights.get(s, 0.0) / total for s in V.SYNTHETIC_SPLITS[:2])
    names = [f"__s{k}" for k in range(len(strata))]
    score, place = hash_score(F.col(key), seed), F.struct(F.col("__score").alias("score"), F.col("__key").alias("key"))
    own = {n: F.struct(c) for n, c in zip(names, strata, strict=True)} | {"__score": score, "__key": F.col(key)}
    scored = df.select(*(c.alias(n) for n, c in own.items())).withColumn("__slice", F.floor(F.col("__score") * SLICES).cast("int"))
    counts = staged(scored.groupBy(*names, "__slice").agg(F.count("*").alias("__m")), "slices")
    before = W.partitionBy(*names).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    summed = counts.withColumns({"__before": F.coalesce(F.sum("__m").over(before), F.lit(0)), "__n": F.sum("__m").over(W.partitionBy(*names))})
    n = F.col("__n")
    cut1 = F.least(F.bround(n * F.lit(first), 0), n).cast("long")
    cut2 = F.greatest(cut1, F.least(F.bround(n * F.lit(first + second), 0), n).cast("long"))
    cuts = summed.select(*names, "__slice", "__before", "__m", F.posexplode(F.array(cut1, cut2)).alias("__cut", "__at")).filter("__at >= __before AND __at < __before + __m")
    cuts = cuts.select(*names, "__slice", "__cut", (F.col("__at") - F.col("__before") + 1).alias("__rank"))
    wanted = staged(cuts.groupBy(*names, "__slice").agg(F.array_sort(F.collect_list(F.struct("__cut", "__rank"))).alias("__cuts")), "cuts")
    few = wanted.count() * 128 <= BROADCAST_BYTES
    inside = scored.join(F.broadcast(wanted) if few else wanted, [*names, "__slice"])
    ranked = inside.withColumn("__r", F.row_number().over(W.partitionBy(*names, "__slice").orderBy("__score", "__key")))
    edge = ranked.select(*names, place.alias("__place"), "__r", F.explode("__cuts").alias("__c")).filter("__r = __c.__rank")
    edges = staged(edge.groupBy(*names).agg(*(F.max(F.when(F.col("__c")["__cut"] == k, F.col("__place"))).alias(f"__edge{k}") for k in (0, 1))), "edges")
    # a stratum that a cut leaves whole has no row at it
    rows = df.withColumns(own).join(F.broadcast(edges) if few else edges, names, "left")
    below = lambda k: F.col(f"__edge{k}").isNull() | (place < F.col(f"__edge{k}"))
    return rows.select(*df.columns, F.when(below(0), V.SYNTHETIC_SPLITS[0]).when(below(1), V.SYNTHETIC_SPLITS[1]).otherwise(V.SYNTHETIC_SPLITS[2]).alias("split"))

def group_split(group: Column, seed: int, weights: dict[str, float] | None = None) -> Column:
    """A group's split by hash score: no shuffle, the same wherever the group stands."""
    return split_of(hash_score(group, seed), cumulative_edges(weights or V.REAL_WEIGHTS, V.REAL_SPLITS))


def grow_manifest(items: DataFrame, frozen: DataFrame, seed: int, weights: dict[str, float] | None = None, assigned_on: str = "") -> DataFrame:
    """The manifest of items (image, group, source) over a frozen one: frozen rows stay, frozen groups keep their split.

    `conflict` is true where an image is frozen in another group.
    """
    kept = frozen.select("image", F.col("group").alias("__group"), F.col("split").alias("__split"), F.col("source").alias("__source"), F.col("assigned_on").alias("__on"), F.col("note").alias("__note"))
    groups = frozen.groupBy("group").agg(F.max_by("split", "image").alias("__group_split"))
    joined = items.join(kept, "image", "full_outer").join(groups, "group", "left")
    old = F.col("__split").isNotNull()
    return joined.select(
        "image", F.coalesce("__group", "group").alias("group"),
        F.coalesce("__split", "__group_split", group_split(F.col("group"), seed, weights)).alias("split"),
        F.when(old, F.col("__source")).otherwise(F.col("source")).alias("source"),
        F.when(old, F.col("__on")).otherwise(F.lit(assigned_on)).alias("assigned_on"),
        F.when(old, F.col("__note")).otherwise(F.lit("")).alias("note"),
        F.coalesce(F.col("__group") != F.col("group"), F.lit(False)).alias("conflict"),
    )


def spanning(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split, with the splits."""
    # distinct first: the sets that meet in one task are as small as the number of splits
    return df.filter(F.col(key).isNotNull()).select(key, split).distinct().groupBy(key).agg(F.count("*").alias("n_splits"), F.array_sort(F.collect_set(split)).alias("splits")).filter("n_splits > 1")


def leaking_pairs(df: DataFrame, key: str, name: str, split: str = "split") -> DataFrame:
    """(key, first, first_split, second, second_split): rows of one key in different splits, first < second.

    Only keys that span splits are paired; leaking_members() is for keys of very many rows.
    """
    hot = spanning(df, key, split).select(key)
    side = lambda a: df.join(hot, key, "left_semi").select(key, F.col(name).alias(a), F.col(split).alias(f"{a}_split"))
    return side("first").join(side("second"), key).filter((F.col("first") < F.col("second")) & (F.col("first_split") != F.col("second_split")))


def leaking_members(df: DataFrame, key: str, name: str, split: str = "split") -> DataFrame:
    """(key, name, split, first) a row a name whose key spans splits, first being the key's smallest name: linear in the rows, where pairs are not."""
    hot = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("__lo"), F.max(split).alias("__hi"), F.min(name).alias("first")).filter("__lo <> __hi").select(key, "first")
    return df.join(hot, key).select(key, F.col(name).alias("name"), F.col(split).alias("split"), "first")


def split_crosstab(df: DataFrame, dimensions: list[str], split: str = "split") -> DataFrame:
    """Counts by split, by split and each dimension, and in all, in one pass of grouping sets."""
    # The dimension that a row counts is told by name and value.
    sets = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))]
    sets += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("value")) for d in dimensions]
    return df.select(split, F.explode(F.array(*sets)).alias("d")).groupBy(split, "d.dimension", "d.value").agg(F.count("*").alias("n"))


def union_lookup(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both manifests by key, those of the preferred one where both have the key."""
    return preferred.unionByName(other.join(preferred.select(key), key, "left_anti"), allowMissingColumns=True)


def holdout(df: DataFrame, split: str = "split") -> DataFrame:
    return df.filter(F.col(split) == "holdout").select("image").distinct()


def load_split(df: DataFrame, name: str, unlock_holdout: str = "") -> DataFrame:
    """Rows of a split; the holdout opens only for a stated reason."""
    if name.endswith("holdout") and not unlock_holdout.strip():
        raise PermissionError("the holdout is opened only with a reason")
    return df.filter(F.col("split") == name)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of the smallest hash scores: a sample without replacement that any order of rows gives alike."""
    return df.orderBy(hash_score(F.col(key), seed), key).limit(n)


def seeded_sample(keys: list[str], n: int, seed: int) -> list[str]:
    """A sample of sorted keys by the standard library's generator, for small lists on the driver."""
    import random

    keys = sorted(keys)
    return sorted(random.Random(seed).sample(keys, min(n, len(keys))))


def strided(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows evenly over the order: rows floor(i * len / n). Positions come from a distributed rank, not from one task.

    The rows are ranked within hash-free ranges of the order; the only rows that meet in one task are one count for each range.
    """
    total = df.count()
    if total <= n:
        return df
    ranked = positions(df, order)
    step = total / n
    # row p is taken if p = floor(i * step) for some i
    i = F.ceil(F.col("position") / F.lit(step) - F.lit(1e-12))
    return ranked.filter((i < n) & (F.floor(i * F.lit(step)) == F.col("position"))).drop("position")


def ranges(df: DataFrame, order: list[Column], name: str, costly: bool = False) -> DataFrame:
    """df cut into ranges of the order, `__part` numbering them; staged, as range edges are sampled and must be the same for every reader.

    costly: df is more than a scan, and is staged before its edges are sampled, so that it is computed once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = staged(df, f"{name}-rows") if costly else df
    return staged(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)


def positions(df: DataFrame, order: str) -> DataFrame:
    """df with `position`, from 0 in the order: a rank in each range, and the rows of the ranges before it."""
    cut = ranges(df, [F.col(order)], "positions")
    within = cut.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1)
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row for each range: as many as there are shuffle partitions
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("position", F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before")


def stepped(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every step-th row of the order from its first, n at most, the step being the rows over n cut to a whole number."""
    if n < 1:
        return positions(df.limit(0), order).drop("position")
    step = max(1, df.count() // n)
    place = F.col("position")
    return positions(df, order).filter((place % step == 0) & (place < n * step)).drop("position")


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of both tables that stand at the same position of their orders, with `position`; what the longer one has left over goes."""
    return positions(left, left_order).join(positions(right, right_order), "position")


def training_pool(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("split") == "synthetic:train")


def grouped_items(meta: DataFrame, groups: DataFrame) -> DataFrame:
    """(image, group, source, problem) a row an image of meta (line, image, source): its source is that of its first line.

    groups (image, group); an image in none, or in one without a name, has a problem instead.
    """
    first = meta.groupBy("image").agg(F.min_by("source", "line").alias("source"))
    known = groups.groupBy("image").agg(F.max("group").alias("group"))
    joined = first.join(known, "image", "left").withColumn("group", F.when(F.col("group") != "", F.col("group")))
    return joined.select("image", "group", "source", F.when(F.col("group").isNull(), F.concat(F.col("image").cast("string"), F.lit(" has no group"))).alias("problem"))


def largest_remainder(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, weight, share): whole shares of total by weight, the rest to the largest fractions, ties by key."""
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(W.partitionBy())
    floored = df.select(key, weight, F.floor(exact).alias("__floor"), (exact - F.floor(exact)).alias("__rest"))
    left = F.lit(total) - F.sum("__floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col("__rest").desc(), F.col(key)))
    return floored.select(key, weight, (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).alias("share"))

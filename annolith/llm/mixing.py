"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key -ln(u) / w, w being its quality
weight; in ascending order of keys this is weighted sampling without
replacement. A source takes as many complete epochs of all its documents as
its target holds, then documents in key order whose prefix-summed sizes fill
the rest. The document at the boundary gives only the words still missing,
so that a source's taken words are its target to within a word.

Edge cases: null texts have size 0 and take nothing; a null source is a source
of its own, last in order; a source of no words has target 0; equal keys are
ordered by doc_id (nulls last), size and checksum of the text; a null doc_id draws by
that checksum; rows equal in all of these are taken one by one; an empty table gives no rows. Extra columns, of
any name, are ignored by mix() and kept by resample().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, staged, unit_draw, words

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Most times that a document may be taken.
MAX_EPOCHS = 2.0
#: Key ranges of each source of which words are summed; the one that holds the target's end is looked into.
SLICES = 4096
#: Copies of one row that are made from one array.
COPIES_AT_ONCE = 1000
SEED = "mix-1"


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.5 and 2: falls with the decoration characters and double exclamation marks a word. The weight of mix(), unless the caller has a better one."""
    noise = F.regexp_count(text, F.lit("[#*$%&|<>]|!!"))
    share = F.least(F.lit(1.0), noise.cast("double") / F.greatest(size, F.lit(1)).cast("double"))
    return F.lit(2.0) - F.lit(1.5) * share


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to also have `target`: words by weight, capped at `most` times the size, the excess reshared by weight.

    Resharing until none is above its cap is water-filling: in ascending order of
    cap / weight the capped sources come first, and a source is capped if the level
    that all capped before it leave is above its own.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn("__w", F.element_at(F.lit(list(weights)).cast("array<double>"), (rank % len(weights) + 1).cast("int")))
    listed = listed.withColumn("__cap", F.lit(most) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = W.orderBy("__ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    levelled = listed.withColumn(
        "__level",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest),
    )
    capped = F.col("__ratio") <= F.col("__level")
    level = F.max(F.when(~capped, F.col("__level"))).over(every)
    return levelled.select("source", "source_size", F.when(capped, F.col("__cap")).otherwise(level * F.col("__w")).alias("target"))


def _drawn(docs: DataFrame, seed: str) -> DataFrame:
    """docs with __size, __key, __slice and __place, what a source's rows are ordered by; equal places are rows of one id, size and checksum."""
    size, crc = F.size(words(F.col("text"))).cast("long"), F.crc32(F.coalesce("text", F.lit("")))
    sized = docs.withColumn("__size", size)
    weight = quality_weight(F.coalesce(F.col("text"), F.lit("")), F.col("__size"))
    # rows without an id draw by their text, so that they do not all share one key
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), crc.cast("string")))
    keyed = sized.withColumn("__key", -F.log(unit_draw(drawn_by, F.lit(seed))) / weight)
    return keyed.withColumns({
        # increasing in the key, and at most 4 / SLICES of a source's ids in one slice whatever the weights
        "__slice": F.least(F.floor(F.lit(float(SLICES)) * (F.lit(1.0) - F.exp(-F.col("__key") / 2.0))), F.lit(SLICES - 1)).cast("int"),
        "__place": F.struct(F.col("__key").alias("key"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("__size").alias("size"), crc.cast("long").alias("crc")),
    })


def boundaries(drawn: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row a source: size, target, complete epochs, and the place at which its fractional epoch ends.

    Rows before __place are taken once more, those after it are not. Of the rows at it, equal in place,
    __full are taken whole, one gives __part words, and the rest nothing. Where the fractional
    epoch is empty, or the whole source, __place is null and __rest says which.
    """
    by_slice = drawn.groupBy("source", "__slice").agg(F.sum("__size").alias("__sum"))
    totals = by_slice.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    planned = source_targets(totals, weights, share, most)
    total = F.col("source_size")
    planned = planned.withColumn("__epochs", F.when(total > 0, F.floor(F.col("target") / total + F.lit(1e-12))).otherwise(F.lit(0)).cast("long"))
    planned = staged(planned.withColumn("__left", F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("__epochs") * total), "source-targets")
    n = planned.count()
    named = lambda df: df.select(F.col("source").alias("__source"), *(c for c in df.columns if c != "source"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    before = lambda order: F.coalesce(F.sum("__sum").over(W.partitionBy("source").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = (
        by_slice.withColumn("__before", before("__slice")).join(small(named(planned.select("source", "__left")), n, 64), same)
        .filter((F.col("__left") > F.col("__before")) & (F.col("__left") <= F.col("__before") + F.col("__sum"))).select("__source", F.col("__slice").alias("__at"), "__left", "__before")
    )
    # One slice of each source is looked into; rows of equal places are one row there.
    inside = drawn.join(small(cut, n, 64), same & (F.col("__slice") == F.col("__at")))
    groups = inside.groupBy("source", "__place", "__left", "__before").agg(F.count("*").alias("__m"), F.sum("__size").alias("__sum"))
    groups = groups.withColumn("__words", F.col("__left") - F.col("__before") - before("__place")).filter((F.col("__words") > 0) & (F.col("__words") <= F.col("__sum")))
    size = F.col("__place")["size"]
    edge = groups.select("source", "__place", F.floor(F.col("__words") / size).cast("long").alias("__full"), (F.col("__words") % size).alias("__part"), "__m")
    return planned.join(small(named(edge), n, 128), same, "left").select(
        "source", "source_size", "target", "__epochs", "__place", "__full", "__part", "__m", (F.col("__left") >= total).alias("__rest")
    )


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """The boundaries, staged, under names of their own, and the columns they were made of."""
    columns = ("doc_id", "source", "__size", "__key", "__slice", "__place")
    drawn = staged(_drawn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), seed).select(*columns), "drawn")
    plan = staged(boundaries(drawn, weights, share, most), "boundaries")
    return drawn, small(plan.select(*(F.col(c).alias(f"__p_{c.strip('_')}") for c in plan.columns)), plan.count(), 160)


def _extra(place: Column) -> Column:
    """1 for a row before its source's boundary, 0 for one after it, null for one at it."""
    edge = F.col("__p_place")
    return F.when(edge.isNull(), F.col("__p_rest").cast("int")).when(place < edge, 1).when(place > edge, 0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: size, its source's size and target, and the words that the mix takes of it."""
    drawn, plan = _planned(docs, weights, share, most, seed)
    rows = drawn.join(plan, F.col("source").eqNullSafe(F.col("__p_source"))).withColumn("__extra", _extra(F.col("__place")))
    size, epochs = F.col("__size"), F.col("__p_epochs")
    clear = rows.filter("__extra is not null").withColumn("__more", F.col("__extra") * size)
    # Rows at the boundary are equal in all that is returned, so any ranking of them gives the same rows.
    tied = rows.filter("__extra is null")
    one = tied.filter("__p_m = 1").withColumn("__more", F.when(F.col("__p_full") > 0, size).otherwise(F.col("__p_part")))
    several = _ranked(tied.filter("__p_m > 1").withColumn("__at", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES))).withColumn("__w", F.lit(1)), "__p_source", "__at", "__at")
    several = several.withColumn("__more", F.when(F.col("__rank") < F.col("__p_full"), size).when(F.col("__rank") == F.col("__p_full"), F.col("__p_part")).otherwise(F.lit(0))).select(*one.columns)
    return clear.unionByName(one).unionByName(several).select(
        "doc_id", size.alias("size"), F.col("__p_source_size").cast("long").alias("source_size"), F.round("__p_target", 6).alias("target"),
        (epochs * size + F.col("__more")).cast("long").alias("taken"), "source", F.col("__key").alias("draw_key"),
    )


def _ranked(df: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """df, staged, with __rank: the sum of __w of the rows before, counted within slices `at` of a key and shifted by those before them."""
    df = staged(df, "tied")
    before = W.partitionBy("__k").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(F.col(key).alias("__k"), F.col(at).alias("__i")).agg(F.sum("__w").alias("__s")).select("__k", "__i", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    within = W.partitionBy(key, at).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("__r", F.coalesce(F.sum("__w").over(within), F.lit(0)))
    return ranked.join(offsets, F.col(key).eqNullSafe(F.col("__k")) & (F.col(at) == F.col("__i"))).withColumn("__rank", F.col("__o") + F.col("__r"))


def resample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: each row once for every complete epoch, once more if it is taken in the fractional one.

    Whole documents only: the boundary document of a source is rounded, so a source is within half of it of its target.
    Every row decides by its own place against its source's boundary, so that texts are not shuffled; only rows at a
    boundary that share their place with others are: equal ones as one row with a count.
    """
    _, plan = _planned(docs, weights, share, most, seed)
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(c) for c in docs.columns)).alias("__row"))
    rows = _drawn(whole, seed).join(plan, F.col("source").eqNullSafe(F.col("__p_source"))).withColumn("__extra", _extra(F.col("__place")))
    rounded = (2 * F.col("__p_part") >= F.col("__size")).cast("int")
    lone = F.col("__p_full") + F.when(F.col("__p_part") > 0, rounded).otherwise(0)
    clear = rows.filter("__extra is not null or __p_m = 1").select("__row", F.when(F.col("__size") > 0, F.col("__p_epochs") + F.coalesce("__extra", lone)).otherwise(0).alias("__copies"))
    # Of several rows at a boundary, `lone` are taken once more, in order of a hash of the whole row.
    tied = rows.filter("__extra is null and __p_m > 1").withColumn("__text", F.to_json("__row"))
    alike = tied.groupBy("__p_source", "__text", "__p_epochs", lone.alias("__lone")).agg(F.first("__row").alias("__row"), F.count("*").alias("__w"))
    several = _ranked(alike.withColumn("__h", F.xxhash64("__text")).withColumn("__at", F.pmod("__h", F.lit(SLICES))), "__p_source", "__at", "__h")
    taken = F.greatest(F.lit(0), F.least(F.col("__w"), F.col("__lone") - F.col("__rank")))
    spread = several.select("__row", (F.col("__p_epochs") * F.col("__w") + taken).alias("__copies"))
    copied = clear.unionByName(spread).filter("__copies > 0").withColumn("__thousands", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / COPIES_AT_ONCE))))
    copied = copied.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES_AT_ONCE), F.col("__copies") - F.col("__thousands") * COPIES_AT_ONCE))))
    return copied.select(*(F.col("__row")[c].alias(c) for c in docs.columns))

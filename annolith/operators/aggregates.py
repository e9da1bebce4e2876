"""Counting, summaries and percentiles of annotated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(df: DataFrame, *keys: Column) -> DataFrame:
    """(keys, n) by falling count, then key."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.orderBy(F.col("n").desc(), *(c for c in out.columns if c != "n"))


def dataset_stats(meta: DataFrame) -> DataFrame:
    """(metric, key, value) in long form, from rules.typed(); a row counts a tag once however often it names it.

    Every row is exploded into the things it counts, plain ones without an item. They are counted by metric, key and item
    first, so that a distinct count is a count of rows and no set is held; one pass over the parsed rows makes all.
    """
    synthetic, real = F.coalesce(F.col("synthetic"), F.lit(False)), F.coalesce(~F.col("synthetic"), F.lit(False))
    source, licence, image = F.col("source_name"), F.col("licence"), F.col("image_path")

    def one(metric: str, key: Column | None = None, item: Column | None = None) -> Column:
        text = lambda c, other: F.lit(other).cast("string") if c is None else c
        return F.struct(F.lit(metric).alias("metric"), text(key, "").alias("key"), text(item, None).alias("item"))

    counts = F.concat(
        F.array(
            one("total_rows"), F.when(synthetic, one("synthetic_rows")), F.when(real, one("real_rows")), F.when(F.col("is_background"), one("background_rows")),
            one("by_plate_type", F.when(F.col("kind") == "", "<blank>").otherwise(F.col("kind"))), F.when(F.size("tags") == 0, one("rows_without_conditions")),
            F.when(source != "", one("by_source", source)), F.when((source == "") & ~synthetic, one("rows_missing_source")),
            F.when(licence != "", one("by_license", licence)), F.when((licence == "") & ~synthetic, one("rows_missing_license")),
            F.when(synthetic, one("synthetic_images", None, image)), F.when(real, one("real_images", None, image)),
            F.when(synthetic | real, one("total_images", None, image)), F.when(F.col("plate") != "", one("unique_plates", F.col("kind"), F.col("plate"))),
        ),
        F.transform(F.array_distinct("tags"), lambda t: one("by_condition", t)),
    )
    each = meta.select(F.explode(counts).alias("c")).filter("c IS NOT NULL").groupBy("c.metric", "c.key", "c.item").agg(F.count("*").alias("n"))
    return each.groupBy("metric", "key").agg(F.sum(F.when(F.col("item").isNull(), F.col("n")).otherwise(1)).alias("value"))


def counted_places(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, __from, __to, __n): the places that each distinct value takes among its group's sorted values, and their number.

    Values are counted, cut into ranges of (keys, value) and summed within a range; the small table of ranges carries the
    sums on, so a group of very many distinct values is shared by as many tasks as it has ranges.
    """
    from .splits import ranges

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    names = [f"__k{i}" for i in range(len(keys))]
    cut = ranges(counts.withColumns({n: F.struct(k) for n, k in zip(names, keys, strict=True)}), [*(F.col(n) for n in names), F.col(value)], "counted-values", costly=True)
    within = W.partitionBy(*names, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*names).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*names, "__part").agg(F.sum("__c").alias("__s"))
    carried = sums.select(*names, "__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"), F.sum("__s").over(W.partitionBy(*names)).alias("__n"))
    placed = cut.withColumn("__run", F.sum("__c").over(within)).join(carried, [*names, "__part"]).withColumn("__to", F.col("__before") + F.col("__run"))
    return placed.select(*keys, value, (F.col("__to") - F.col("__c")).alias("__from"), "__to", "__n")


def _median(places: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, median): the mean of the two middle values."""
    low, high = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    at = lambda place: F.max(F.when((place >= F.col("__from")) & (place < F.col("__to")), F.col(value)))
    both = places.groupBy(*keys).agg(at(low).alias("__a"), at(high).alias("__b"))
    return both.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) / 2).alias("median"))


def numeric_summary(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, min, median, mean, max): the median interpolated, the mean to one decimal."""
    by = [*(keys or []), "column"]
    long = df.select(*(keys or []), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*(keys or []), "x.*")
    sums = long.groupBy(*by).agg(F.min("v").alias("min"), F.bround(F.avg("v"), 1).alias("mean"), F.max("v").alias("max"))
    middle = _median(counted_places(long, "v", by), "v", by).select(F.struct(*by).alias("__key"), "median")
    # keys may be null, which structs of them are not
    return sums.withColumn("__key", F.struct(*by)).join(middle, "__key", "left").select(*by, "min", "median", "mean", "max")


def nearest_rank(df: DataFrame, value: str, shares: list[float], keys: list[str], index: str = "floor") -> DataFrame:
    """(keys, share, value) at place floor(n * share), or round_half_even(share * (n - 1)), of the sorted values; exact."""
    each = counted_places(df, value, keys).withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares))))
    place = F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.col("share"))) if index == "floor" else F.bround(F.col("share") * (F.col("__n") - 1), 0)
    return each.filter((place >= F.col("__from")) & (place < F.col("__to"))).select(*keys, "share", F.col(value).alias("value"))


def upper_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The element at place n // 2 of the sorted values."""
    return nearest_rank(df, value, [0.5], keys).drop("share")


def top_below(df: DataFrame, value: str, below: float, k: int, tie: str) -> DataFrame:
    """The k largest values below a threshold, larger ties first: a top-k that Spark takes without a full sort."""
    return df.filter(F.col(value) < below).orderBy(F.col(value).desc(), F.col(tie).desc()).limit(k)


def largest_per_group(df: DataFrame, keys: list[str], value: Column, *ordinal: str) -> DataFrame:
    """The row of the largest value in each group, the first on ties; missing values come last. The ordinals may be strings, as the name of a row's file is."""
    falling = F.struct(value.isNull(), ~F.isnan(value.cast("double")), -value)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(falling, *ordinal)).alias("r")).select("r.*")


def run_stats(records: DataFrame, stage_columns: list[str]) -> DataFrame:
    """(stage, mean, median, p95, n) of milliseconds by stage; p95 at the half-even place."""
    long = records.select(F.explode(F.array(*(F.struct(F.lit(c).alias("stage"), F.col(c).cast("double").alias("ms")) for c in stage_columns))).alias("x")).select("x.*")
    p95 = nearest_rank(long, "ms", [0.95], ["stage"], "round").select("stage", F.col("value").alias("p95"))
    middle = _median(counted_places(long, "ms", ["stage"]), "ms", ["stage"])
    return long.groupBy("stage").agg(F.avg("ms").alias("mean"), F.count("ms").alias("n")).join(middle, "stage").join(p95, "stage").select("stage", "mean", "median", "n", "p95")


def samples_per_image(df: DataFrame, image: str, ordinal: str) -> DataFrame:
    return df.groupBy(image).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal), *(F.col(c) for c in df.columns if c not in (image, ordinal))))).alias("samples"))


def largest_group(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest_group"))


def resolutions(images: DataFrame, most: int = 10) -> DataFrame:
    """(resolution, n, distinct) of the most common sizes of readable images, ties by text; distinct counts all sizes."""
    sized = images.filter("width is not null and height is not null").groupBy(F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("resolution")).agg(F.count("*").alias("n"))
    return sized.orderBy(F.col("n").desc(), "resolution").limit(most).join(F.broadcast(sized.agg(F.count("*").alias("distinct"))))


def span(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, min, median, max) of whole numbers, the median cut to a whole number."""
    return df.groupBy(*(keys or [])).agg(F.min(value).alias("min"), F.floor(F.percentile(value, 0.5)).cast("long").alias("median"), F.max(value).alias("max"))


def annotation_totals(labels: DataFrame) -> DataFrame:
    """One row of labels (image, boxes array, problems array): boxes, and label files with a problem and the problems themselves."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return labels.agg(n(F.greatest(F.size("boxes"), F.lit(0))).alias("boxes"), n(F.size("problems") > 0).alias("invalid_files"), n(F.greatest(F.size("problems"), F.lit(0))).alias("problems"))


def has_findings(counts: DataFrame) -> DataFrame:
    """One row `found`: whether any of an audit's counts (name, n) is above 0."""
    return counts.agg(F.coalesce(F.max(F.col("n") > 0), F.lit(False)).alias("found"))


def sample_summary(samples: DataFrame) -> DataFrame:
    """(metric, key, value): rows, images, plates that can be read, distinct plates, and rows by class, split and tag.

    samples (image, plate_num, plate_type, split, tags). Distinct counts are counts of rows after a first aggregation.
    """
    from ..functions.text import trainable

    def one(metric: str, key: Column | None = None, item: Column | None = None) -> Column:
        return F.struct(F.lit(metric).alias("metric"), (F.lit("") if key is None else key).alias("key"), (F.lit(None).cast("string") if item is None else item).alias("item"))

    plate, kind = F.col("plate_num"), F.col("plate_type")
    each = F.concat(
        F.array(
            one("rows"), one("images", None, F.col("image").cast("string")), one("by_class", kind), one("by_split", F.col("split")),
            F.when(trainable(plate, kind), one("readable")), F.when(plate != "", one("plates", None, plate)),
        ),
        F.transform("tags", lambda t: one("by_tag", t)),
    )
    counted_items = samples.select(F.explode(F.filter(each, lambda c: c.isNotNull())).alias("c")).groupBy("c.metric", "c.key", "c.item").agg(F.count("*").alias("n"))
    return counted_items.groupBy("metric", "key").agg(F.sum(F.when(F.col("item").isNull(), F.col("n")).otherwise(1)).alias("value"))

"""Watermarked counts and duplicate suppression over an event stream, and a split manifest that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import group_split, grow_manifest
from ..sources.tables import exists


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def first_events(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def split_stream(items: DataFrame, group: str, seed: int) -> DataFrame:
    """Items with their split: hash edges need no state, so a stream and a batch agree."""
    return items.withColumn("split", group_split(F.col(group), seed))


MANIFEST = "image string, `group` string, split string, source string, assigned_on string, note string"


def grow(manifest_path: str, seed: int):
    """A foreachBatch function that keeps a manifest: each batch is assigned over the rows written so far.

    Of those only the images and groups of the batch are looked up, in three columns of a columnar manifest. A batch that is
    tried again finds its images there and adds nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(MANIFEST).parquet(manifest_path) if exists(spark, manifest_path) else spark.createDataFrame([], MANIFEST)
        fresh = batch.join(known.select("image"), "image", "left_anti").dropDuplicates(["image"])
        groups = known.select("group", "split", "image").join(fresh.select("group").distinct(), "group", "left_semi")
        assigned = grow_manifest(fresh, groups.select("image", "group", "split", *(F.lit("").alias(c) for c in ("source", "assigned_on", "note"))), seed, assigned_on=str(epoch))
        added = assigned.join(fresh.select("image"), "image", "left_semi").drop("conflict")
        added.write.mode("append").parquet(manifest_path)

    return run

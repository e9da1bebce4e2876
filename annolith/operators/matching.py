"""Greedy box matching and suppression: a fold over each image's own boxes, which are in one row, with explicit tie rules; batches of images fold at once (fold.py)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import iou
from . import fold

MATCHES = "array<struct<t:int,p:int,score:double>>"
#: Pairs of one image above which its boxes meet by grid cells.
CROWD = 1 << 14


def by_score(predictions: Column) -> Column:
    """Predictions (ordinal, score, box) by falling score; ties keep the input order."""
    keyed = F.transform(predictions, lambda p: F.struct((-p["score"]).alias("k"), p["ordinal"].alias("o"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def _every_pair(images: DataFrame, image: str, left: str, right: str) -> DataFrame:
    pairs = images.select(image, F.explode(left).alias("l"), right).select(image, "l", F.explode(right).alias("r"))
    return pairs.select(image, "l", "r", iou(F.col("l.box"), F.col("r.box")).alias("overlap"))


def _pairs_by_cells(images: DataFrame, image: str, left: str, right: str) -> DataFrame:
    """Overlapping pairs of crowded images: boxes are dealt to the cells of a grid and meet in the cell of their intersection's corner.

    A cell is as wide as the image's median box, and wide enough that there are no more cells than boxes. Cells, not images, are dealt
    to tasks, so that the boxes of one image meet in many.
    """
    boxes = F.concat(*(F.transform(c, lambda b: b["box"]) for c in (left, right)))
    sides = F.array_sort(F.transform("__boxes", lambda b: F.greatest(b["w"], b["h"])))
    reach = lambda at, size: F.array_max(F.transform("__boxes", lambda b: b[at] + b[size])) - F.array_min(F.transform("__boxes", lambda b: b[at]))
    n = F.size("__boxes")
    cell = F.greatest(F.get(sides, F.floor(n / 2).cast("int")), F.greatest(reach("x", "w"), reach("y", "h")) / F.sqrt(n), F.lit(1e-9))
    sized = images.withColumn("__boxes", boxes).withColumn("__cell", cell)
    place = lambda v: F.floor(v / F.col("__cell")).cast("long")

    def dealt(side: str, name: str) -> DataFrame:
        each = sized.select(image, "__cell", F.explode(side).alias(name)).filter(f"{name}.box.w > 0 AND {name}.box.h > 0")
        b = F.col(name)["box"]
        across = each.withColumn("__x", F.explode(F.sequence(place(b["x"]), place(b["x"] + b["w"]))))
        return across.withColumn("__y", F.explode(F.sequence(place(b["y"]), place(b["y"] + b["h"]))))

    met = dealt(left, "l").join(dealt(right, "r").drop("__cell"), [image, "__x", "__y"])
    own = lambda at: place(F.greatest(F.col("l")["box"][at], F.col("r")["box"][at]))
    return met.filter((own("x") == F.col("__x")) & (own("y") == F.col("__y"))).select(image, "l", "r", iou(F.col("l.box"), F.col("r.box")).alias("overlap"))


def close_pairs(images: DataFrame, image: str, left: str, right: str, least: float) -> DataFrame:
    """(image, l, r, overlap): pairs of each image's arrays of boxes whose IoU is `least` or more, scored as compiled code.

    The boxes of an image with more than CROWD pairs meet by grid cells, so that its pairs are about as many as those that overlap.
    """
    if least <= 0:  # boxes that do not overlap count too
        return _every_pair(images, image, left, right).filter(F.col("overlap") >= least)
    crowded = F.size(left).cast("long") * F.size(right) > CROWD
    pairs = _every_pair(images.filter(~crowded), image, left, right).unionByName(_pairs_by_cells(images.filter(crowded), image, left, right))
    return pairs.filter(F.col("overlap") >= least)


def _folded(images: DataFrame, columns: tuple[str, ...], name: str, kind: T.DataType, run: Callable[..., pa.Array], without: tuple[str, ...] = ()) -> DataFrame:
    """images with a column of what run(boxes of the columns) gives for a chunk of them; the columns `without` do not travel back."""
    back = [f for f in images.schema.fields if f.name not in without]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fold.chunks(batches, *columns):
            values = run(batch.num_rows, *(fold.Boxes(batch.column(c)) for c in columns))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, name])

    names = [f.name for f in back]
    return images.mapInArrow(each, T.StructType([*back, T.StructField(name, kind)]))


def suppressed_crowds(images: DataFrame, image: str, boxes: str, threshold: float) -> DataFrame:
    """images with `kept`: what suppressed() keeps, for images of any number of boxes."""
    crowd = CROWD

    def run(rows: int, own: fold.Boxes) -> pa.Array:
        at = fold.kept(own, own.ranked(), threshold, crowd)
        return fold.lists(own.items.take(pa.array(at)), own.image[at], rows)

    return _folded(images, (boxes,), "kept", images.schema[boxes].dataType, run)


def suppressed(boxes: Column, threshold: float) -> Column:
    """Boxes (ordinal, score, box) kept by non-maximum suppression, by falling score: a box goes if its IoU with a kept one is above the threshold."""
    start = F.slice(boxes, F.lit(1), F.lit(0))
    step = lambda acc, q: F.when(F.exists(acc, lambda m: iou(m["box"], q["box"]) > threshold), acc).otherwise(F.concat(acc, F.array(q)))
    return F.aggregate(by_score(boxes), start, step)


def postprocess(boxes: Column, size: float, scale_x: Column, scale_y: Column, score: float, overlap: float, top: int, most: int) -> Column:
    """Threshold, top-k, clip, suppress, limit and rescale an image's xyxy-decoded boxes."""
    likely = F.slice(by_score(F.filter(boxes, lambda b: b["score"] > score)), 1, top)

    def clipped(b: Column) -> Column:
        x1, y1, x2, y2 = (F.least(F.lit(size), F.greatest(F.lit(0.0), v)) for v in (b["box"]["x"], b["box"]["y"], b["box"]["x"] + b["box"]["w"], b["box"]["y"] + b["box"]["h"]))
        return F.struct(b["ordinal"].alias("ordinal"), b["score"].alias("score"), F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")).alias("box"))

    kept = F.slice(suppressed(F.transform(likely, clipped), overlap), 1, most)
    return F.transform(kept, lambda b: F.struct(
        b["ordinal"].alias("ordinal"), b["score"].alias("score"),
        F.struct((b["box"]["x"] * scale_x).alias("x"), (b["box"]["y"] * scale_y).alias("y"), (b["box"]["w"] * scale_x).alias("w"), (b["box"]["h"] * scale_y).alias("h")).alias("box"),
    ))


def postprocessed(images: DataFrame, image: str, boxes: str, size: float, scale_x: Column, scale_y: Column, score: float, overlap: float, top: int, most: int) -> DataFrame:
    """images with `kept`, what postprocess() gives, in place of their boxes."""
    crowd = CROWD

    def run(rows: int, own: fold.Boxes) -> pa.Array:
        own.clip(size)
        scores = own.items.field("score")
        likely = np.asarray(scores.cast(pa.float64()).fill_null(-np.inf))
        order = own.ranked()
        order = order[(likely[order] > score) | np.isnan(likely[order])]
        place = lambda at: np.arange(len(at)) - np.searchsorted(own.image[at], own.image[at], "left")
        at = fold.kept(own, order[place(order) < top], overlap, crowd)
        at = at[place(at) < most]
        box = pa.StructArray.from_arrays([pa.array(v[at]) for v in (own.x, own.y, own.w, own.h)], list("xywh"))
        chosen = pa.array(at)
        return fold.lists(pa.StructArray.from_arrays([own.items.field("ordinal").take(chosen), scores.take(chosen), box], ["ordinal", "score", "box"]), own.image[at], rows)

    kept = _folded(images, (boxes,), "kept", T.ArrayType(T._parse_datatype_string("ordinal int, score double, box struct<x:double,y:double,w:double,h:double>")), run, (boxes,))
    scaled = lambda b: F.struct((b["x"] * scale_x).alias("x"), (b["y"] * scale_y).alias("y"), (b["w"] * scale_x).alias("w"), (b["h"] * scale_y).alias("h"))
    return kept.withColumn("kept", F.transform("kept", lambda b: F.struct(b["ordinal"].alias("ordinal"), b["score"].alias("score"), scaled(b["box"]).alias("box"))))


def grouped_boxes(df: DataFrame, image: str, ordinal: Column, box: Column, score: Column | None = None, name: str = "boxes", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per image: its boxes in order of their ordinals, with the columns `more`. An image's boxes fit one row."""
    fields = [ordinal.cast("int").alias("ordinal"), box.alias("box")]
    if score is not None:
        fields.insert(1, score.cast("double").alias("score"))
    return df.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(*fields, *more))).alias(name))


def grouped_pairs(df: DataFrame, image: str, ordinal: Column, truth: Column, predicted: Column, score: Column, more: tuple[str, ...] = (), read: dict[str, str] | None = None) -> DataFrame:
    """images (image, truth, predictions) of rows that hold a true and a predicted box each, grouped once; `more` of the truths, `read` of the predictions by name."""
    own = F.struct(ordinal.cast("int").alias("ordinal"), truth.alias("box"), *more)
    found = F.struct(ordinal.cast("int").alias("ordinal"), score.cast("double").alias("score"), predicted.alias("box"), *(F.col(c).alias(k) for k, c in (read or {}).items()))
    return df.groupBy(image).agg(F.sort_array(F.collect_list(own)).alias("truth"), F.sort_array(F.collect_list(found)).alias("predictions"))


def paired(truth: DataFrame, predictions: DataFrame | None, image: str) -> DataFrame:
    """Truth images with their predictions; predictions of unknown images are ignored. truth (image, truth), predictions (image, predictions), or none if truth has both."""
    if predictions is None:
        return truth
    empty = F.array().cast(predictions.schema["predictions"].dataType)
    return truth.join(predictions, image, "left").withColumn("predictions", F.coalesce("predictions", empty))


def matched_images(truth: DataFrame, predictions: DataFrame | None, image: str, threshold: float) -> DataFrame:
    """Truth images with their predictions and matches at one threshold: each prediction in score order takes the free truth of highest IoU at or above it, the later one on ties."""
    crowd = CROWD

    def run(rows: int, own: fold.Boxes, found: fold.Boxes) -> pa.Array:
        t, p, overlap = fold.candidates(own, found, threshold, crowd)
        at = fold.matched(own, found, t, p, overlap, threshold)
        t, p = t[at], p[at]
        ordinal = lambda boxes, k: boxes.items.field("ordinal").take(pa.array(k)).cast(pa.int32())
        matches = pa.StructArray.from_arrays([ordinal(own, t), ordinal(found, p), found.items.field("score").take(pa.array(p)).cast(pa.float64())], ["t", "p", "score"])
        return fold.lists(matches, found.image[p], rows)

    return _folded(paired(truth, predictions, image), ("truth", "predictions"), "matches", T._parse_datatype_string(MATCHES), run)


def ladder_rows(images: DataFrame, image: str, ladder: tuple[float, ...]) -> DataFrame:
    """(image, score, n, hits_0, hits_1, ..., truths): predictions of an image that share a score, and how many of them are matched at each threshold.

    Overlapping pairs are found once, for the least threshold. `truths` is counted in rows of its own, a row a chunk, whose n is 0.
    """
    crowd = CROWD
    names = [image, "score", "n", *(f"hits_{k}" for k in range(len(ladder))), "truths"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fold.chunks(batches, "truth", "predictions"):
            own, found = fold.Boxes(batch.column("truth")), fold.Boxes(batch.column("predictions"))
            order, key = found.ranked(), found.rank()
            fresh = np.ones(len(order), bool)
            fresh[1:] = (found.image[order][1:] != found.image[order][:-1]) | (key[order][1:] != key[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(fresh) - 1
            lead = order[fresh]
            t, p, overlap = fold.candidates(own, found, min(ladder), crowd)
            hits = [np.bincount(group[p[fold.matched(own, found, t, p, overlap, th)]], minlength=len(lead)) for th in ladder]
            counts = [np.append(c, 0) for c in (np.bincount(group, minlength=len(lead)), *hits)] + [np.append(np.zeros(len(lead), np.int64), len(own.x))]
            picked = lambda values, at: values.take(pa.array([*at.tolist(), None], pa.int64()))
            columns = [picked(batch.column(image), found.image[lead]), picked(found.items.field("score"), lead), *(pa.array(c.astype(np.int64)) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [T.StructField(image, images.schema[image].dataType), T.StructField("score", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in names[2:])]
    return images.mapInArrow(each, T.StructType(kinds))


def scored_list(matched: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, score, is_tp): the list that average precision ranks; by image, all matches first, then the unmatched by score."""
    hits = F.transform("matches", lambda m: F.struct(m["score"].alias("score"), F.lit(True).alias("is_tp")))
    own = F.transform("matches", lambda m: m["p"])
    free = F.filter(by_score(F.col("predictions")), lambda q: ~F.array_contains(own, q["ordinal"]))
    misses = F.transform(free, lambda q: F.struct(q["score"].alias("score"), F.lit(False).alias("is_tp")))
    # The outer form: from the inner one Spark infers a filter on the array and evaluates the fold once more.
    listed = matched.select(*keys, F.posexplode_outer(F.concat(hits, misses)).alias("place", "s")).filter("place is not null")
    return listed.select(*keys, "place", "s.score", "s.is_tp")

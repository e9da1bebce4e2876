"""Review selection: flags of an image, suggestions that abstain, candidates by shape and colour, and the facts told to a reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import geometry as G
from ..functions import text as X
from .coverage import merge_candidates

FLAG = V.REVIEW_FLAGS


def review_items(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row an image: number of boxes, the largest (the first on ties), and its flags in order.

    images (image, width, height, readable, renamed), boxes (image, ordinal, cx, cy, w, h) in shares of the image. An
    unreadable image has no further flags, nor has one without boxes.
    """
    boxes = boxes.withColumns({c: F.col(c).cast("double") for c in ("cx", "cy", "w", "h")})
    share = G.box(F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("w"), F.col("h"))
    summed = boxes.groupBy("image").agg(
        F.count("*").alias("plates"), F.max_by(F.struct("w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("ordinal"))).alias("largest"),
        F.max(G.touches_edge(share)).alias("edge"),
    )
    df = images.join(summed, "image", "left").withColumn("plates", F.when(F.col("readable"), F.coalesce("plates", F.lit(0))).otherwise(0))
    some = F.col("plates") > 0
    df = df.withColumns({
        "largest_width": F.when(some, F.col("largest.w") * F.col("width")), "largest_height": F.when(some, F.col("largest.h") * F.col("height")),
        "area_share": F.when(some, F.col("largest.w") * F.col("largest.h")),
    })
    df = df.withColumn("aspect", F.when(some, F.when(F.col("largest_height") != 0, F.col("largest_width") / F.col("largest_height")).otherwise(F.lit(0.0))))
    flags = [
        (F.col("renamed"), "renamed"), (~F.col("readable"), "unreadable"), (F.col("readable") & ~some, "empty"), (F.col("plates") > 1, "several"),
        (some & (F.col("aspect") >= V.WIDE_ASPECT), "wide"), (some & (F.col("aspect") <= V.SQUARE_ASPECT), "square"),
        (some & (F.col("aspect") > V.SQUARE_ASPECT) & (F.col("aspect") < V.WIDE_ASPECT), "between"),
        (some & (F.col("largest_width") < V.TINY_WIDTH), "tiny"), (some & (F.col("largest_width") >= V.TINY_WIDTH) & (F.col("largest_width") < V.SMALL_WIDTH), "small"),
        (some & F.col("edge"), "edge"),
    ]
    each = F.filter(F.array(*(F.when(c, FLAG[k]) for c, k in flags)), lambda f: f.isNotNull())
    return df.select("image", "width", "height", "plates", "largest_width", "largest_height", "aspect", "area_share", each.alias("flags"))


def flag_counts(items: DataFrame) -> DataFrame:
    return items.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def suggestion(flags: Column, plates: Column) -> Column:
    """struct(suggested, reason): never a type, as shape alone tells none; the reason says what was missing."""
    shape = F.get(F.filter(flags, lambda f: f.isin(*(FLAG[k] for k in ("wide", "square", "between")))), F.lit(0))
    reason = (
        F.when(F.array_contains(flags, FLAG["unreadable"]), "the image cannot be read").when(plates == 0, "no box to judge")
        .otherwise(F.concat(F.lit("the shape is "), X.text_or_empty(shape), F.lit("; colour is not known from geometry")))
    )
    return F.struct(F.lit(V.ABSTAIN).alias("suggested"), reason.alias("reason"))


def colour_strength(reliable: Column, y: Column, cb: Column, cr: Column, margin: Column) -> Column:
    """none, weak or strong."""
    is_yellow = F.coalesce(G.yellow_candidate(reliable, y, cb, cr, margin), F.lit(False))
    return F.when(~is_yellow, "none").when(G.yellowness(cb, cr) >= V.STRONG_YELLOWNESS, "strong").otherwise("weak")


def rare_suggestion(reasons: Column, strength: Column) -> Column:
    """type1b where a strong yellow was measured, else an abstention."""
    return F.when(F.array_contains(reasons, V.REASON_YELLOW) & (strength == "strong"), "type1b").otherwise(V.ABSTAIN)


def shape_candidates(items: DataFrame) -> DataFrame:
    """(path, reasons) of images flagged square or in between."""
    wanted = F.array_intersect(F.array(F.lit(FLAG["square"]), F.lit(FLAG["between"])), F.col("flags"))
    return items.select(F.col("image").alias("path"), wanted.alias("reasons")).filter(F.size("reasons") > 0)


def colour_candidates(colours: DataFrame, shortlist: int = V.YELLOW_SHORTLIST) -> DataFrame:
    """(path, reasons, colour): images above the yellow threshold, and of the other reliable ones the most yellow, later paths first on ties.

    colours (path, reliable, y, cb, cr, margin); colour is the yellowness.
    """
    scored = colours.select("path", "reliable", G.yellowness(F.col("cb"), F.col("cr")).alias("colour"), F.coalesce(G.yellow_candidate(F.col("reliable"), F.col("y"), F.col("cb"), F.col("cr"), F.col("margin")), F.lit(False)).alias("hit"))
    told = lambda df, reason: df.select("path", F.array(F.lit(reason)).alias("reasons"), "colour")
    near = scored.filter(~F.col("hit") & F.col("reliable") & F.col("colour").isNotNull()).orderBy(F.col("colour").desc(), F.col("path").desc()).limit(shortlist)
    return told(scored.filter("hit"), V.REASON_YELLOW).unionByName(told(near, V.REASON_MOST_YELLOW))


def scan_summary(colours: DataFrame, shape: DataFrame, shortlist: int = V.YELLOW_SHORTLIST) -> DataFrame:
    """One row: images scanned, unreliable ones, candidates by threshold, shortlist and shape, both kinds at once, and all."""
    found = colour_candidates(colours, shortlist)
    merged = merge_candidates(shape.withColumn("colour", F.lit(None).cast("double")), found)
    is_yellow = F.array_contains("reasons", V.REASON_YELLOW) | F.array_contains("reasons", V.REASON_MOST_YELLOW)
    is_shape = F.arrays_overlap("reasons", F.array(F.lit(FLAG["square"]), F.lit(FLAG["between"])))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = merged.agg(
        n(F.array_contains("reasons", V.REASON_YELLOW)).alias("threshold"), n(F.array_contains("reasons", V.REASON_MOST_YELLOW)).alias("shortlist"),
        n(is_shape).alias("shape"), n(is_shape & is_yellow).alias("both"), F.count("*").alias("candidates"),
    )
    return colours.agg(F.count("*").alias("scanned"), n(~F.col("reliable")).alias("unreliable")).join(counts)


def _pixels(w: Column, h: Column) -> Column:
    return F.format_string("%.0fx%.0fpx", F.bround(w, 0), F.bround(h, 0))


def machine_facts(items: DataFrame) -> Column:
    """What was measured of an item, without the sink's delimiter; no claim about its type."""
    known = F.when((F.col("width") > 0) & (F.col("height") > 0), F.format_string("image %dx%d", F.col("width"), F.col("height")))
    box = F.concat(
        F.col("plates").cast("string"), F.lit(" box(es), largest "), _pixels(F.col("largest_width"), F.col("largest_height")),
        F.format_string(", aspect %.2f, %.2f%% of frame", F.bround("aspect", 2), F.bround(F.col("area_share") * 100, 2)),
    )
    flags = F.when(F.size("flags") > 0, F.concat(F.lit("flags: "), F.array_join("flags", ", ")))
    return F.replace(F.concat_ws(" | ", known, F.when(F.col("plates") > 0, box).otherwise(F.lit("no annotated plate")), flags), F.lit(";"), F.lit(","))


def tags_of(night: Column, yaw: Column, pitch: Column, roll: Column, dirt: Column, glare_on_plate: Column, blur: Column, rain: Column, snow: Column) -> Column:
    """Condition tags of generation parameters, in the vocabulary's order; an absent effect is NULL."""
    turned = F.greatest(F.abs(yaw), F.abs(pitch), F.abs(roll)) > V.ANGLE_DEGREES
    holds = {
        "day": ~night, "night": night, "rain": rain, "snow": snow, "dirt": dirt >= V.DIRT_STRENGTH, "glare": glare_on_plate,
        "motion_blur": blur >= V.BLUR_PIXELS, "angle": turned,
    }
    return F.filter(F.array(*(F.when(F.coalesce(holds[t], F.lit(False)), t) for t in V.CONDITIONS)), lambda t: t.isNotNull())

"""Boxes, quads and colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two xywh boxes; 0 where the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = wide * high
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def signed_area(q: Column) -> Column:
    """Shoelace area of array(x1, y1, ..., x4, y4); positive if clockwise on screen."""
    cross = [F.get(q, F.lit(2 * i)) * F.get(q, F.lit((2 * i + 3) % 8)) - F.get(q, F.lit((2 * i + 2) % 8)) * F.get(q, F.lit(2 * i + 1)) for i in range(4)]
    return (cross[0] + cross[1] + cross[2] + cross[3]) / 2


def corners(q: Column) -> Column:
    return F.array(*(F.struct(F.get(q, F.lit(2 * i)).alias("x"), F.get(q, F.lit(2 * i + 1)).alias("y")) for i in range(4)))


def is_convex(q: Column) -> Column:
    """Whether all turns have one sign and none is zero."""
    p = lambda i, k: F.get(q, F.lit((2 * i + k) % 8))
    turns = [(p(i + 1, 0) - p(i, 0)) * (p(i + 2, 1) - p(i + 1, 1)) - (p(i + 1, 1) - p(i, 1)) * (p(i + 2, 0) - p(i + 1, 0)) for i in range(4)]
    every = F.array(*turns)
    return F.forall(every, lambda t: t > 0) | F.forall(every, lambda t: t < 0)


def quad_extent(q: Column) -> Column:
    """The xywh box that bounds a quad."""
    xs, ys = F.array(*(F.get(q, F.lit(i)) for i in (0, 2, 4, 6))), F.array(*(F.get(q, F.lit(i)) for i in (1, 3, 5, 7)))
    return from_corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def quad_deviation(q: Column, b: Column) -> Column:
    """Largest distance of a quad's extent from a box, as a share of the box's side; b is array(x, y, w, h). NULL for an empty box."""
    e = quad_extent(q)
    x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
    far = F.greatest(
        F.try_divide(F.abs(e["x"] - x), w), F.try_divide(F.abs(e["x"] + e["w"] - (x + w)), w),
        F.try_divide(F.abs(e["y"] - y), h), F.try_divide(F.abs(e["y"] + e["h"] - (y + h)), h),
    )
    return F.when((w > 0) & (h > 0), far)


def quad_aspect(q: Column) -> Column:
    """Mean length of the long sides over that of the short ones; infinite if the latter is 0."""
    p = lambda i: F.get(q, F.lit(i))
    top, right = F.hypot(p(2) - p(0), p(3) - p(1)), F.hypot(p(4) - p(2), p(5) - p(3))
    bottom, left = F.hypot(p(4) - p(6), p(5) - p(7)), F.hypot(p(6) - p(0), p(7) - p(1))
    return F.when(right + left > 0, (top + bottom) / (right + left)).otherwise(F.lit(float("inf")))


def is_two_line(q: Column, below: float = 2.5) -> Column:
    return quad_aspect(q) < below


def shape_flag(aspect: Column) -> Column:
    return F.when(aspect >= 3.2, "one_line").when(aspect <= 2.4, "two_line").otherwise("ambiguous")


def touches_edge(b: Column, margin: float = 0.01) -> Column:
    """Whether a box in shares of the image lies within the margin of an edge."""
    return (b["x"] <= margin) | (b["y"] <= margin) | (b["x"] + b["w"] >= 1 - margin) | (b["y"] + b["h"] >= 1 - margin)


def width_bin(w: Column) -> Column:
    return F.when(w < 80, "<80px").when(w < 150, "80-150px").otherwise(">=150px")


def height_bin(h: Column) -> Column:
    return F.when(h.isNull(), "unknown").when(h < 10, "<10px").when(h < 14, "10-14px").when(h < 20, "14-20px").when(h < 30, "20-30px").otherwise(">=30px")


def expanded(b: Column, share: float, width: Column, height: Column) -> Column:
    """A box grown by a share of its sides on every side, clipped to the image."""
    x1, y1 = F.greatest(F.lit(0.0), b["x"] - share * b["w"]), F.greatest(F.lit(0.0), b["y"] - share * b["h"])
    x2, y2 = F.least(width.cast("double"), b["x"] + (1 + share) * b["w"]), F.least(height.cast("double"), b["y"] + (1 + share) * b["h"])
    return from_corners(x1, y1, x2, y2)


def quad_in_crop(q: Column, crop: Column) -> Column:
    """A quad's coordinates as shares of a crop box."""
    w, h = F.greatest(crop["w"], F.lit(1e-6)), F.greatest(crop["h"], F.lit(1e-6))
    return F.transform(q, lambda v, i: F.when(i % 2 == 0, (v - crop["x"]) / w).otherwise((v - crop["y"]) / h))


def quad_from_crop(q: Column, crop: Column) -> Column:
    return F.transform(q, lambda v, i: F.when(i % 2 == 0, crop["x"] + v * crop["w"]).otherwise(crop["y"] + v * crop["h"]))


def six_decimals(share: Column) -> Column:
    """A share of an image, 0 to 1, with six decimals, half-even; as a decimal, since a formatter parses its pattern for every cell."""
    return F.bround(share, 6).cast("decimal(20, 6)").cast("string")


def yolo_line(b: Column, width: Column, height: Column, label: Column) -> Column:
    """`class cx cy w h` in shares of the image, clipped, six decimals; NULL for a box outside the image."""
    x1, y1 = F.greatest(F.lit(0.0), b["x"]), F.greatest(F.lit(0.0), b["y"])
    x2, y2 = F.least(width.cast("double"), b["x"] + b["w"]), F.least(height.cast("double"), b["y"] + b["h"])
    six = six_decimals
    line = F.concat_ws(" ", label.cast("string"), six((x1 + x2) / 2 / width), six((y1 + y2) / 2 / height), six((x2 - x1) / width), six((y2 - y1) / height))
    return F.when((x2 > x1) & (y2 > y1), line)


def to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """Full-range YCbCr to clamped 8-bit RGB."""
    clamp = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.bround(v, 0).cast("int")))
    return F.struct(
        clamp(y + 1.402 * (cr - 128)).alias("r"), clamp(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)).alias("g"), clamp(y + 1.772 * (cb - 128)).alias("b")
    )


def hex_colour(rgb: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(rgb[k]), 2, "0") for k in "rgb")))


def yellowness(cb: Column, cr: Column) -> Column:
    """How far a colour lies towards yellow: blue difference down, red difference up."""
    return (V.NEUTRAL_CHROMA - cb) + (cr - V.NEUTRAL_CHROMA)


def scaled_box(cx: Column, cy: Column, w: Column, h: Column, scale: float) -> Column:
    """array(x1, y1, x2, y2) of a box in shares of the image, scaled about its centre and clipped."""
    low = lambda c, d: F.greatest(F.lit(0.0), c - d * scale / 2)
    high = lambda c, d: F.least(F.lit(1.0), c + d * scale / 2)
    return F.array(low(cx, w), low(cy, h), high(cx, w), high(cy, h))


def ring_value(outer: Column, inner: Column) -> Column:
    """The mean of the ring between the inner share of a box and the scaled box around it, from the means of both."""
    own, around = V.INNER_SHARE**2, V.RING_SCALE**2
    return (outer * around - inner * own) / (around - own)


def keypoint_line(b: Column, quad: Column, width: Column, height: Column) -> Column:
    """`0 cx cy w h` and each corner as `x y 2`, in shares of the image, clipped, six decimals; NULL for a box outside it."""
    inside = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    points = (F.concat(six_decimals(inside(F.get(quad, F.lit(i)) / (height if i % 2 else width))), F.lit(" 2" if i % 2 else "")) for i in range(8))
    # concat gives NULL for the NULL line of a box outside the image; points that are missing are left out
    return F.concat(yolo_line(b, width, height, F.lit(0)), F.when(quad.isNull(), "").otherwise(F.concat(F.lit(" "), F.concat_ws(" ", *points))))


def yellow_candidate(reliable: Column, y: Column, cb: Column, cr: Column, margin: Column) -> Column:
    return reliable & (y >= 55) & (cb <= 115) & (cr >= 133) & (margin >= 12)

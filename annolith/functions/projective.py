"""Perspective maps of quads: eight unknowns solved for whole Arrow batches at once, points mapped as column arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once


def solve(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """n x 8 coefficients of maps that take n x 4 x 2 source points to target points; NaN where the points are degenerate."""
    n = len(source)
    x, y, u, v = source[:, :, 0], source[:, :, 1], target[:, :, 0], target[:, :, 1]
    system = np.zeros((n, 8, 8))
    system[:, 0::2, 0], system[:, 0::2, 1], system[:, 0::2, 2] = x, y, 1
    system[:, 1::2, 3], system[:, 1::2, 4], system[:, 1::2, 5] = x, y, 1
    for at, value in ((0, u), (1, v)):
        system[:, at::2, 6], system[:, at::2, 7] = -value * x, -value * y
    right = np.stack([u, v], 2).reshape(n, 8, 1)
    out = np.full((n, 8), np.nan)
    whole = np.isfinite(system).all((1, 2)) & np.isfinite(right).all((1, 2))
    whole[whole] = np.abs(np.linalg.det(system[whole])) > 1e-12
    out[whole] = np.linalg.solve(system[whole], right[whole])[:, :, 0]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def perspective(source: pd.Series, target: pd.Series) -> pd.Series:
    """Coefficients that map one array(x1, y1, ..., x4, y4) onto another; NULL where a quad is NULL or degenerate."""
    known = (source.notna() & target.notna()).to_numpy()
    if not known.any():
        return pd.Series([None] * len(source), dtype=object)
    quads = [np.stack([np.asarray(q, float).reshape(4, 2) for q in side[known]]) for side in (source, target)]
    found = iter(solve(*quads))
    return pd.Series([row.tolist() if k and np.isfinite(row := next(found)).all() else None for k in known], dtype=object)


def mapped(coefficients: Column, x: Column, y: Column) -> Column:
    """The point that a map takes (x, y) to."""
    c = lambda i: F.get(coefficients, F.lit(i))
    below = c(6) * x + c(7) * y + 1
    return F.struct(((c(0) * x + c(1) * y + c(2)) / below).alias("x"), ((c(3) * x + c(4) * y + c(5)) / below).alias("y"))


def rotation(yaw: float, pitch: float, roll: float) -> np.ndarray:
    """The matrix of a roll after a yaw after a pitch, in degrees; x right, y down, z away."""
    a, b, c = np.radians([yaw, pitch, roll])

    def turn(angle: float, i: int, j: int) -> np.ndarray:
        m = np.eye(3)
        m[i, i] = m[j, j] = np.cos(angle)
        m[i, j], m[j, i] = -np.sin(angle), np.sin(angle)
        return m

    return turn(c, 0, 1) @ turn(-a, 0, 2) @ turn(b, 1, 2)


def projected(points: np.ndarray, turn: np.ndarray, distance: float) -> np.ndarray:
    """Plane points (n x 2) after a turn, seen from a distance along z."""
    placed = np.column_stack([points, np.zeros(len(points))]) @ turn.T
    return placed[:, :2] * (distance / (distance + placed[:, 2]))[:, None]


# --- placement, a row at a time as columns ---------------------------------------------


def seen_corners(width: Column, height: Column, yaw: Column, pitch: Column, roll: Column, px_per_mm: Column, distance_ratio: Column) -> Column:
    """array(x1, y1, ..., x4, y4): the corners of a plate of width x height mm, clockwise from the upper left, about its centre in pixels.

    Angles in degrees, turned as rotation() does. Seen from distance_ratio widths away, by a lens that shows an unturned plate at px_per_mm. NULL if a corner lies behind the viewer.
    """
    a, b, c = (F.radians(v) for v in (yaw, pitch, roll))
    # the first two columns of the turn: plates are flat
    cos, sin = F.cos, F.sin
    first = (cos(c) * cos(a), sin(c) * cos(a), -sin(a))
    second = (cos(c) * sin(a) * sin(b) - sin(c) * cos(b), sin(c) * sin(a) * sin(b) + cos(c) * cos(b), cos(a) * sin(b))
    distance = distance_ratio * width
    axes = F.array(*first, *second, distance, px_per_mm * distance)
    corners = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]

    def shown(t: Column) -> Column:
        at = lambda i: F.get(t, F.lit(i))
        depth = [at(6) + x * width * at(2) + y * height * at(5) for x, y in corners]
        flat = [at(7) * (x * width * at(k) + y * height * at(3 + k)) / z for (x, y), z in zip(corners, depth, strict=True) for k in (0, 1)]
        return F.when(F.least(*depth) > 1e-6, F.array(*flat))

    return once(axes, shown)


def _reach(quad: Column) -> Column:
    """struct(x1, y1, x2, y2): the box that bounds a quad."""
    side = lambda k: F.array(*(F.get(quad, F.lit(i + k)) for i in (0, 2, 4, 6)))
    return F.struct(F.array_min(side(0)).alias("x1"), F.array_min(side(1)).alias("y1"), F.array_max(side(0)).alias("x2"), F.array_max(side(1)).alias("y2"))


def fitting_scale(quad: Column, width: Column, height: Column, margin: float) -> Column:
    """The largest scale of 1 or less at which a quad fits into an image with a margin; in closed form, without a search. NULL if the margin leaves no room."""
    room = lambda size: size - 2 * margin
    scale = once(_reach(quad), lambda r: F.least(F.lit(1.0), F.try_divide(room(width), r["x2"] - r["x1"]), F.try_divide(room(height), r["y2"] - r["y1"])))
    return F.when((room(width) > 0) & (room(height) > 0), scale)


def placed_quad(quad: Column, width: Column, height: Column, u: Column, v: Column, margin: float, least_y: Column | None = None) -> Column:
    """A quad about its centre moved wholly into an image: u and v in [0, 1] tell where in the room that is left its centre comes to lie.

    least_y keeps the centre at or below a line where that leaves room. NULL if the quad does not fit.
    """

    def moved(r: Column) -> Column:
        x1, x2, y1, y2 = margin - r["x1"], width - margin - r["x2"], margin - r["y1"], height - margin - r["y2"]
        top = y1 if least_y is None else F.when(least_y <= y2, F.greatest(y1, least_y)).otherwise(y1)
        slack = 1e-9  # a quad that was scaled to fit may miss by a rounding
        centre = F.struct((x1 + F.greatest(x2 - x1, F.lit(0.0)) * u).alias("x"), (top + F.greatest(y2 - top, F.lit(0.0)) * v).alias("y"))
        return F.when((x1 <= x2 + slack) & (y1 <= y2 + slack), centre)

    return once(once(_reach(quad), moved), lambda c: F.when(c.isNotNull(), F.transform(quad, lambda p, i: p + F.when(i % 2 == 0, c["x"]).otherwise(c["y"]))))

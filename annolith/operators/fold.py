"""Greedy folds over the boxes of many images at once, as array steps on batches that Spark deals out; each image's boxes are in one row.

A step takes the k-th candidate of every image of a chunk, so that small images cost no loop of their own. The boxes of a crowded
image meet along one axis: a pair is sought only where the left edge of one lies in the other, and in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs of boxes that are scored at once, and boxes of the images of a chunk.
PAIRS, BOXES = 1 << 20, 1 << 18


class Boxes:
    """The boxes of a list column, flat: `image` is the row of each, `first` and `count` the range of each row."""

    def __init__(self, lists: pa.ListArray):
        self.items = lists.flatten()
        self.count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.image = np.repeat(np.arange(len(lists)), self.count)
        box = self.items.field("box")
        self.x, self.y, self.w, self.h = (np.asarray(box.field(k).cast(pa.float64()).fill_null(np.nan)) for k in "xywh")
        self.ordinal = np.asarray(self.items.field("ordinal").cast(pa.int64()).fill_null(-1))

    def rank(self) -> np.ndarray:
        """Falling score as a key that rises; a missing score stands first, NaN last."""
        score = self.items.field("score")
        return np.where(np.asarray(score.is_null()), -np.inf, -np.asarray(score.cast(pa.float64()).fill_null(0)))

    def ranked(self) -> np.ndarray:
        """Places by image and falling score; ties keep the input order."""
        return np.lexsort((self.ordinal, self.rank(), self.image))

    def clip(self, size: float) -> None:
        edge = lambda v: np.fmin(size, np.maximum(0.0, v))
        x2, y2 = edge(self.x + self.w), edge(self.y + self.h)
        self.x, self.y = edge(self.x), edge(self.y)
        self.w, self.h = x2 - self.x, y2 - self.y


def iou(a: Boxes, i: np.ndarray, b: Boxes, j: np.ndarray) -> np.ndarray:
    """As geometry.iou() has it, operation by operation."""
    wide = np.maximum(0.0, np.minimum(a.x[i] + a.w[i], b.x[j] + b.w[j]) - np.maximum(a.x[i], b.x[j]))
    high = np.maximum(0.0, np.minimum(a.y[i] + a.h[i], b.y[j] + b.h[j]) - np.maximum(a.y[i], b.y[j]))
    both = wide * high
    union = a.w[i] * a.h[i] + b.w[j] * b.h[j] - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, both / union, 0.0)


def _runs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all places of the ranges first, first + 1, ..., PAIRS at a time; a range may be cut."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for k in range(0, total, PAIRS):
        at = np.arange(k, min(total, k + PAIRS))
        row = np.searchsorted(ends, at, "right")
        yield row, first[row] + at - (ends[row] - count[row])


def close(a: Boxes, b: Boxes, least: float, crowd: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of the pairs of each image whose IoU is `least` or more (strict: more)."""
    found = []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        overlap = iou(a, i, b, j)
        good = overlap > least if strict else overlap >= least
        found.append((i[good], j[good], overlap[good]))

    crowded = (a.count * b.count > crowd) & (least >= 0 if strict else least > 0)
    plain = np.flatnonzero(~crowded[a.image])
    for row, j in _runs(b.first[a.image[plain]], b.count[a.image[plain]]):
        meet(plain[row], j)
    if crowded.any():
        # places in the order of image and left edge; complex numbers compare by their real part first
        for left, right, side in ((a, b, "left"), (b, a, "right")):
            own, other = np.flatnonzero(crowded[left.image] & (left.w > 0)), np.flatnonzero(crowded[right.image] & (right.w > 0))
            other = other[np.lexsort((right.x[other], right.image[other]))]
            key = right.image[other] + 1j * right.x[other]
            begin = np.searchsorted(key, left.image[own] + 1j * left.x[own], side)
            end = np.searchsorted(key, left.image[own] + 1j * (left.x[own] + left.w[own]), "left")
            for row, place in _runs(begin, np.maximum(0, end - begin)):
                i, j = own[row], other[place]
                meet(i, j) if left is a and side == "left" else meet(j, i)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def candidates(truth: Boxes, predictions: Boxes, least: float, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, p, overlap) in the order in which a greedy match tries them: by image and falling score, ties in input order; the truths by falling IoU, the later one on ties."""
    t, p, overlap = close(truth, predictions, least, crowd)
    order = np.lexsort((-truth.ordinal[t], -overlap, predictions.ordinal[p], predictions.rank()[p], predictions.image[p]))
    return t[order], p[order], overlap[order]


def _steps(image: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the first row of every image, then of every second one, and so on; rows are sorted by image."""
    fresh = np.flatnonzero(np.append(True, image[1:] != image[:-1])) if len(image) else np.empty(0, np.int64)
    count = np.diff(np.append(fresh, len(image)))
    order = np.argsort(-count, kind="stable")
    fresh, count = fresh[order], count[order]
    for k in range(count[0] if len(count) else 0):
        yield fresh[: np.searchsorted(-count, -k, "left")] + k


def matched(truth: Boxes, predictions: Boxes, t: np.ndarray, p: np.ndarray, overlap: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the candidates that are chosen: each prediction takes its first free truth at or above the threshold."""
    able = np.flatnonzero(overlap >= threshold)
    t, p = t[able], p[able]
    chosen, taken, done = np.zeros(len(able), bool), np.zeros(len(truth.x), bool), np.zeros(len(predictions.x), bool)
    for at in _steps(predictions.image[p]):
        at = at[~taken[t[at]] & ~done[p[at]]]
        chosen[at] = taken[t[at]] = done[p[at]] = True
    return able[chosen]


def kept(boxes: Boxes, order: np.ndarray, threshold: float, crowd: int) -> np.ndarray:
    """Of the places in `order` (by image and falling score), those that non-maximum suppression keeps."""
    rank = np.full(len(boxes.x), -1)
    rank[order] = np.arange(len(order))
    i, j, _ = close(boxes, boxes, threshold, crowd, strict=True)
    first, second = rank[i], rank[j]
    good = (first >= 0) & (first < second)
    first, second = first[good], second[good]
    # all pairs of a box come after those that decide whether it stays; of an image, one box a step
    image = boxes.image[order]
    begin = np.searchsorted(image, image, "left")
    step = np.arange(len(order)) - begin
    by = np.argsort(step[first], kind="stable")
    first, second = first[by], second[by]
    gone = np.zeros(len(order), bool)
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(step[first])) + 1):
        gone[second[part][~gone[first[part]]]] = True
    return order[~gone]


def lists(values: pa.Array, image: np.ndarray, rows: int) -> pa.ListArray:
    """values, sorted by image, as a list for each of `rows` images."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(image, np.arange(rows + 1)).astype(np.int32)), values)


def chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where their lists of boxes reach BOXES."""
    for batch in batches:
        size = sum(np.asarray(batch.column(c).value_lengths().fill_null(0)).astype(np.int64) for c in columns)
        cut = np.cumsum(size) // BOXES
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)

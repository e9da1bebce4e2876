"""Arrays as sequences: collapsing repeats, best paths, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(codes: Column, blank: int = 0) -> Column:
    """Consecutive repeats once, then blanks dropped."""
    kept = F.filter(F.transform(codes, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(codes, i - 1) == x, F.lit(False)).alias("again"))), lambda s: ~s["again"] & (s["x"] != blank))
    return F.transform(kept, lambda s: s["x"])


def softmax(values: Column) -> Column:
    most = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - most))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def best_path(steps: Column, blank: int = 0) -> Column:
    """array<struct<code,score>> from array<struct<code,score>> by step: runs of one code keep their best score, blanks go."""
    empty = F.array().cast("array<struct<code:int,score:double>>")
    start = F.struct(empty.alias("out"), F.lit(-1).alias("last"))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        merged = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["code"].alias("code"), F.greatest(last["score"], s["score"]).alias("score"))))
        grown = F.concat(acc["out"], F.array(F.struct(s["code"].cast("int").alias("code"), s["score"].cast("double").alias("score"))))
        out = F.when(s["code"] == blank, acc["out"]).when(s["code"] == acc["last"], merged).otherwise(grown)
        return F.struct(out.alias("out"), s["code"].cast("int").alias("last"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def gaps(boxes: Column, left: Column, right: Column) -> Column:
    """array<struct(centre, width)> of the gaps before, between and after boxes struct(x1, x2) along a line, widest first, the leftmost on ties."""
    sortd = F.array_sort(boxes)
    starts = F.concat(F.transform(sortd, lambda b: b["x1"]), F.array(right))
    ends = F.concat(F.array(left), F.transform(sortd, lambda b: b["x2"]))
    placed = F.zip_with(ends, starts, lambda a, b: F.struct((a - b).alias("k"), ((a + b) / 2).alias("centre")))
    order = F.array_sort(F.transform(placed, lambda g, i: F.struct(g["k"].alias("k"), i.alias("i"), g["centre"].alias("centre"))))
    return F.transform(order, lambda g: F.struct(g["centre"].alias("centre"), (-g["k"]).alias("width")))

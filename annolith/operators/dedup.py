"""Exact duplicates, first-seen duplicates and near-duplicate vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n, names): keys of more than one row, with their names in one row each; duplicate_members() is for keys of very many rows."""
    several = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return df.join(several, key).groupBy(key, "n").agg(F.array_sort(F.collect_list(name)).alias("names"))


def duplicate_members(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, first) a row a name whose key has several rows, first being the smallest: the form for keys that a third of all rows may share."""
    several = df.groupBy(key).agg(F.min(name).alias("first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return df.join(several, key).select(key, F.col(name).alias("name"), "first")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that repeat a key, with `first`, where the key was first seen. The first place is an aggregate, so a hot key shuffles once a task."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first")).select(*(F.col(k).alias(f"__{k}") for k in keys), "first")
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(first, cond).filter(F.col(order) > F.col("first")).drop(*(f"__{k}" for k in keys))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the one last in order, as a dictionary filled in order would leave it."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


#: Vectors of a block; every block meets every other in a task, so that a vector is shuffled once a block.
BLOCK_ROWS = 8192
#: Vectors of a block that are multiplied with another block at once.
STRIPE_ROWS = 512


def correlated_pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(first, second, score): all pairs whose Pearson correlation reaches the threshold, first < second; exact.

    The vectors are dealt into blocks of about BLOCK_ROWS, and every two blocks
    meet in one task as matrix products of standardised vectors, a stripe at a time. The work is
    quadratic, as the operator is; a task's memory is not. Vectors travel in single precision if they came so, and are
    multiplied in double. Vectors of different lengths, and NULL ones, never pair;
    a constant vector correlates with nothing. For large tables use banded_pairs().
    """
    kind = df.schema[key].dataType.simpleString()
    precision = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast(precision).alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = rows.withColumn("b", own).withColumn("g", F.explode(meets)).select("g.i", "g.j", "b", "id", "v")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby(pdf.v.map(len)):
            z = np.vstack(same.v.to_numpy()).astype(np.float64)
            spread = z.std(1, keepdims=True)
            z = (z - z.mean(1, keepdims=True)) / np.where(spread == 0, 1, spread)
            left, right = np.flatnonzero(same.b == pdf.i.iloc[0]), np.flatnonzero(same.b == pdf.j.iloc[0])
            ids, other, met = same.id.to_numpy(), z[right].T, []
            for k in range(0, max(1, len(left)), STRIPE_ROWS):
                score = z[left[k : k + STRIPE_ROWS]] @ other / z.shape[1]
                a, b = np.nonzero(score >= threshold)
                met.append((ids[left[a + k]], ids[right[b]], score[a, b]))
            first, second, score = (np.concatenate(x) for x in zip(*met, strict=True))
            found = pd.DataFrame({"first": first, "second": second, "score": score})
            inside = pdf.i.iloc[0] == pdf.j.iloc[0]
            swap = found["first"] > found["second"]
            if not inside:
                found.loc[swap, ["first", "second"]] = found.loc[swap, ["second", "first"]].to_numpy()
            found = found[found["first"] < found["second"]]
            out.append(found.astype({"first": object, "second": object}) if kind == "string" else found)
        return pd.concat(out)

    return dealt.groupBy("i", "j").applyInPandas(pairs, f"first {kind}, second {kind}, score double")


def banded_pairs(df: DataFrame, key: str, vector: str, threshold: float, bands: int = 12, bits: int = 10) -> DataFrame:
    """Approximate correlated_pairs() for large tables: pairs that agree in one band of sign projections, verified exactly.

    A pair of correlation r agrees in a sign with probability 1 - acos(r) / pi; at 0.97 a
    band of ten signs meets with 0.44 and one of twelve bands with 0.999.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    @F.pandas_udf("struct<keys: array<long>>")
    def banded(v: pd.Series) -> pd.DataFrame:
        keys, planes = [], {}
        for x in v:
            x = np.asarray(x, float)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng(len(x)).standard_normal((bands * bits, len(x)))
            signs = planes[len(x)] @ (x - x.mean()) > 0
            keys.append(np.packbits(np.pad(signs.reshape(bands, bits), ((0, 0), (64 - bits, 0))), axis=1).view(">i8").ravel().astype("int64"))
        return pd.DataFrame({"keys": keys})

    @F.pandas_udf("double")
    def correlation(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = (np.asarray(v, float) - np.mean(v) for v in (x, y))
            spread = x.std() * y.std()
            return float((x * y).mean() / spread) if spread else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    # Only ids meet by cell; a pair's vectors are joined once it is known.
    cells = rows.select("id", F.posexplode(banded("v")["keys"]).alias("band", "cell"))
    met = cells.withColumnRenamed("id", "first").join(cells.withColumnRenamed("id", "second"), ["band", "cell"]).filter("first < second").select("first", "second").distinct()
    vectors = lambda side, name: rows.select(F.col("id").alias(side), F.col("v").alias(name))
    both = met.join(vectors("first", "va"), "first").join(vectors("second", "vb"), "second").filter(F.size("va") == F.size("vb"))
    return both.select("first", "second", correlation("va", "vb").alias("score")).filter(F.col("score") >= threshold)

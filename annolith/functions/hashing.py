"""Stable hash scores, derived seeds and combined digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def hash_score(key: Column, seed: int | str) -> Column:
    """A double in [0, 1): the first eight bytes of SHA-256 of `seed:key`, most significant first, over 2**64."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def derived_seed(*parts: Column) -> Column:
    """decimal(20,0): the first eight bytes of SHA-256 of the parts joined by colons, least significant first."""
    head = F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16)
    swapped = F.concat(*(F.substring(head, k, 2) for k in range(15, 0, -2)))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def cumulative_edges(weights: dict[str, float], order: tuple[str, ...]) -> list[tuple[str, float]]:
    """(split, upper edge) in order; an edge is the running share of the weights up to its split."""
    share = {name: float(weights.get(name, 0)) for name in order}
    faults = [f"{name!r} is no split" for name in weights if name not in share] + [f"{name!r} has the weight {w}" for name, w in share.items() if w < 0]
    whole = sum(share.values())
    if faults or not whole:
        raise ValueError("; ".join(faults) or "no split has a weight")
    return list(zip(order, accumulate(w / whole for w in share.values()), strict=True))


def split_of(score: Column, edges: list[tuple[str, float]]) -> Column:
    """The split at the place that counts the edges at or below the score; an edge of 1 or more is above every score. NULL past the last one."""
    passed = [(score >= upper).cast("int") for _, upper in edges if upper < 1.0]
    return F.get(F.array(*(F.lit(name) for name, _ in edges)), sum(passed, F.lit(0)))


def combined_digests(df: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, digest, n): SHA-256 of a group's sorted lines, joined by line feeds.

    The format is one stream of bytes a group, so a group is one task's work; its sorted lines pass through the
    hash as they come and are never held, so memory does not grow with it.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("digest", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, n, done = None, None, 0, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, text in zip(*columns, strict=True):
                if digest is None or key != at:
                    if digest is not None:
                        done.append((*at, digest.hexdigest(), n))
                    at, digest, n = key, hashlib.sha256(), 0
                digest.update((b"\n" if n else b"") + text.encode())
                n += 1
        if digest is not None:
            done.append((*at, digest.hexdigest(), n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), to_arrow_schema(schema), strict=True)], schema.names)

    rows = df.select(*keys, line.alias("__line"))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, "__line").mapInArrow(run, schema)

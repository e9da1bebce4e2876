"""Pieces that the corpus operators share: words, staged tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rows times bytes a row above which a side is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the maximal runs of anything but SPACES; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def unit_draw(*cols: Column) -> Column:
    """A double strictly between 0 and 1 from the md5 of the columns' text, joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in cols))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="annolith-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Tables written by staged() in this process, in order.
STAGED: list[str] = []


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        STAGED.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors, is never recomputed."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows fit BROADCAST_BYTES; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def weighed(df: DataFrame) -> DataFrame:
    """df, which is staged, marked for broadcast if the bytes of all its values, summed, fit BROADCAST_BYTES."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.size(c), F.lit(0)) * 64 if kind.startswith("array") else F.lit(56 if kind.startswith("struct") else 12) for c, kind in df.dtypes]
    total = df.agg(F.sum(sum(sizes, F.lit(40)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def fits(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def dense(values: DataFrame, index: str, value: Column, size: int, chunk: int = 4096) -> DataFrame:
    """One row, `values`: the array of value by index from 0 to size - 1, put together in chunks; `value` is null-safe for places that no row names."""
    every = values.sparkSession.range(size).select(F.col("id").alias("__i")).join(values.withColumnRenamed(index, "__i"), "__i", "left")
    listed = lambda s: F.transform(F.array_sort(F.collect_list(s)), lambda x: x["v"])
    chunks = every.groupBy(F.floor(F.col("__i") / chunk).alias("c")).agg(listed(F.struct("__i", value.alias("v"))).alias("v"))
    return chunks.agg(F.flatten(listed(F.struct("c", "v"))).alias("values"))


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among gone's, staged and distinct; docs may have columns of any name."""
    row = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*(F.col(c) for c in docs.columns)).alias("__row"))
    kept = row.join(small(gone.select(F.col("doc_id").alias("__id")), gone.count(), 24), "__id", "left_anti")
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows of the smallest hashes of key, all of them if there are fewer.

    A hash cut by the counted size comes first, so that no task keeps `rows` rows of its own for the final order.
    """
    total = df.count()
    if total > rows:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * rows / total)))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(rows)

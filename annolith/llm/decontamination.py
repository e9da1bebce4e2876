"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two). Within
a partition whose largest set has u shingles, an item's sketch is its
bottom-k MinHash values with k = u - ceil(t * u) + 1: a document that holds the
share t of the item's shingles misses fewer than k of them, so it must hit
the sketch, in k minus what it may miss of the item's own values. That bounds the work by the short side: documents of any length are
probed by membership and need no signature of their own. Candidates are then
verified by exact containment of shingle strings.

Words are lower-cased and parted by ASCII white space; shingles have five
words. An item of fewer words is one shingle, its whole sequence, which only
documents of that same sequence have.

Edge cases: null or blank texts have no shingles and match nothing; repeated
rows of a doc_id count as one document holding the union of their shingles; an
empty table on either side gives no rows; equal items are each reported; null doc_ids and item_ids are
never reported by matches(), and rows of null doc_id are kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, dense, fits, small, staged, without_ids, words

SHINGLE = 5
CONTAINMENT = 0.75
#: Bytes of a sketch's value as broadcast, and bits of the sieve that stands before a shuffled join.
SKETCH_BYTES = 40
SIEVE_BITS = 1 << 27


def _shingled(df: DataFrame, id_col: str) -> DataFrame:
    # Blank texts are told by their trimmed text: a filter on the words would be pushed to the scan and split every text twice.
    filled = F.col(id_col).isNotNull() & (F.btrim("text", F.lit(SPACES)) != "")
    return df.filter(filled).select(F.col(id_col), words(F.lower("text")).alias("__w")).withColumn("__n", F.size("__w"))


def _by_place(w: Column, n: Column, make) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))
    return F.transform(starts, make)


def _hashes(w: Column, n: Column) -> Column:
    """xxhash64 of every shingle; places beyond the end are null, which the hash skips."""
    return _by_place(w, n, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))


def _strings(w: Column, n: Column) -> Column:
    return _by_place(w, n, lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, __h, n_shingles): the distinct shingles of each item."""
    each = _shingled(items, "item_id").select("item_id", F.explode(F.array_distinct(_strings(F.col("__w"), F.col("__n")))).alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    parts = F.split("shingle", " ")
    return each.withColumn("__h", F.xxhash64(*(F.get(parts, F.lit(k)) for k in range(SHINGLE)))).join(sizes, "item_id")


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, __h, n_shingles, size_class): the bottom-k values of each item, k by size class."""
    classed = shingles.withColumn("size_class", F.floor(F.log2(F.col("n_shingles").cast("double"))).cast("int"))
    largest = classed.groupBy("size_class").agg(F.max("n_shingles").alias("__u"))
    k = F.col("__u") - F.ceil(F.col("__u") * F.lit(containment) - F.lit(1e-9)) + 1
    # Items are short texts: an item's values are one array of its own.
    bottom = classed.groupBy("item_id", "n_shingles", "size_class").agg(F.sort_array(F.collect_set("__h")).alias("__all")).join(largest, "size_class")
    kept = F.slice("__all", F.lit(1), k.cast("int"))
    # Of the sketch, a document that holds the share of the item's shingles misses no more than it may miss of them all.
    spare = F.col("n_shingles") - F.ceil(F.col("n_shingles") * F.lit(containment) - F.lit(1e-9))
    hits = F.greatest(F.lit(1), F.size(kept) - spare).cast("int")
    return bottom.select("item_id", "n_shingles", "size_class", hits.alias("hits_needed"), F.explode(kept).alias("__h"))


def _sifted(probe: DataFrame, sketch: DataFrame) -> DataFrame:
    """probe without most of the values that no sketch has, for sketches too many to broadcast: a bit a value, SIEVE_BITS of them, is all that every task holds."""
    bit = F.pmod(F.col("__h"), F.lit(SIEVE_BITS))
    one = sketch.select((bit / 64).cast("bigint").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    bits = dense(one, "word", F.coalesce("b", F.lit(0).cast("bigint")), SIEVE_BITS // 64).scalar()
    return probe.withColumn("__s", bits).filter(F.getbit(F.get("__s", (bit / 64).cast("int")), (bit % 64).cast("int")) == 1).drop("__s")


def matches(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every document and item at or above the threshold."""
    shingles = staged(item_shingles(items), "item-shingles")
    sketch = staged(sketches(shingles, containment), "item-sketches")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    probe = _shingled(narrow, "doc_id").select("doc_id", F.explode(_hashes(F.col("__w"), F.col("__n"))).alias("__h"))
    n = sketch.count()
    probe = probe if fits(n, SKETCH_BYTES) else _sifted(probe, sketch)
    hits = probe.join(small(sketch, n, SKETCH_BYTES), "__h").select("doc_id", "item_id", "hits_needed", "__h").distinct()
    # The rows of a doc_id count together, so nothing is asked of one row alone.
    found = hits.groupBy("doc_id", "item_id", "hits_needed").agg(F.count("*").alias("__met")).filter("__met >= hits_needed")
    found = staged(found.select("doc_id", "item_id"), "leak-candidates")

    ids = found.select("doc_id").distinct()
    held = narrow.join(small(ids, found.count(), 24), "doc_id", "left_semi")
    exact = _shingled(held, "doc_id").select("doc_id", F.explode(F.array_distinct(_strings(F.col("__w"), F.col("__n")))).alias("shingle"))
    both = exact.join(small(shingles, shingles.count(), 120), "shingle").join(found, ["doc_id", "item_id"], "left_semi")
    shared = both.groupBy("doc_id", "item_id", "n_shingles").agg(F.countDistinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return shared.filter(share >= containment - 1e-9).select(
        "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_item_shingles"), "n_shared", F.round(share, 6).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without those that hold an item."""
    leaked = staged(matches(docs, items, containment).select("doc_id").distinct(), "leaked")
    return without_ids(docs, leaked)

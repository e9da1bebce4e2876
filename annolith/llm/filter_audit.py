"""How quality filters interact: what each filter of every order removes, what it repeats, and its Shapley share.

Five filters fail a document: A has few words, B few distinct words, C many
capitals, D a symbol, E is a later copy. Every text is read once for A to D.

Copies are found by partition refinement. All rows are one class; they are split
by code-point length, then by the hash of one block of the text after another,
each block longer than the last and the last one open, and a row alone in its
class drops out before the next block is looked at. Only the texts of rows that
are left are compared in full, by grouping on the text itself, so that a
collision of hashes never makes a copy. The first id of each text stays; rows of
larger ids are marked.

Each row is then a mask of the filters that it fails. Rows are counted by part and
mask, 32 masks a part at most, and all 120 orders are told from these counts, so that
orders cost nothing by the document. A filter of a mask with m failing filters comes first in
120 / m of the orders, which sums up its removals over all orders without running them.

Edge cases: a null text is empty; empty texts are copies of each other, fail A alone of the first four, and have
no words or code points to compare; a null source is the part ''; a row without doc_id is neither a smaller
nor a later copy and has no labels; rows of one doc_id are equal in order, so none is the later copy of the other;
several labels of an id count as one, 1 if any is 1; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged, words

#: Bits of a mask by place.
NAMES = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Ends of the blocks in code points; a last block holds the rest.
BLOCK_ENDS = (64, 512, 4096)
BLOCKS = len(BLOCK_ENDS) + 1
KEYS = ["__length", *(f"__b{k}" for k in range(BLOCKS))]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column, found: Column) -> Column:
    """Bits of A to D of a text without nulls; found: the array of its words."""
    n, length = F.size(found), F.length(text)
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    fails = (n < FEW_WORDS, 100 * F.size(F.array_distinct(found)) < DISTINCT_SHARE * n, 100 * capitals > CAPITAL_SHARE * length, text.rlike(SYMBOLS))
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def block_hash(text: Column, block: int) -> Column:
    """The hash of one block of a text, 0 where the text ends before it."""
    begin = BLOCK_ENDS[block - 1] if block else 0
    part = F.substr(text, F.lit(begin + 1), F.lit(BLOCK_ENDS[block] - begin)) if block < len(BLOCK_ENDS) else F.substr(text, F.lit(begin + 1))
    return F.when(F.length(text) > begin, F.xxhash64(part)).otherwise(F.lit(0).cast("long"))


def with_keys(docs: DataFrame) -> DataFrame:
    """__id, __part, __text and what the refinement splits by."""
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    return rows.select("*", F.length("__text").alias("__length"), *(block_hash(F.col("__text"), k).alias(f"__b{k}") for k in range(BLOCKS)))


def masked(rows: DataFrame) -> DataFrame:
    """rows of with_keys() with `__mask` of A to D."""
    return rows.withColumn("__words", words(F.col("__text"))).withColumn("__mask", text_mask(F.col("__text"), F.col("__words"))).drop("__words")


def refined(rows: DataFrame) -> DataFrame:
    """The distinct keys, all blocks long, of rows that share theirs with others: a class is split by a key at a time and singletons go."""
    left = rows.select(*KEYS)
    for k in range(len(KEYS)):
        shared = staged(left.groupBy(*KEYS[: k + 1]).count().filter("count > 1").drop("count"), f"copies-{k}")
        if k + 1 < len(KEYS):
            left = left.join(small(shared, shared.count(), 8 * (k + 2)), KEYS[: k + 1], "left_semi")
    return shared


def later_copies(keyed: DataFrame, features: DataFrame) -> DataFrame:
    """features with the bit of E in `__mask`. keyed: with_keys(); features: its rows masked, without texts."""
    shared = refined(features)
    n_shared = shared.count()
    alike = keyed.join(small(shared, n_shared, 48), KEYS, "left_semi")
    texts = staged(alike.groupBy(*KEYS, "__text").agg(F.min("__id").alias("__first")).drop("__text"), "texts")
    classes = texts.groupBy(*KEYS).agg(F.count("*").alias("__texts"), F.min("__first").alias("__first"))
    bit = F.when(F.col("__id") > F.col("__first"), 1 << NAMES.index("E")).otherwise(0)
    plain = classes.filter("__texts = 1").drop("__texts")
    out = features.join(small(plain, n_shared, 64), KEYS, "left")
    mixed = staged(classes.filter("__texts > 1").select(*KEYS), "collided")
    n_mixed = mixed.count()
    if n_mixed:  # hashes that collide in every block: their rows are told by their texts
        out = out.join(small(mixed, n_mixed, 48), KEYS, "left_anti")
        rows = keyed.join(small(mixed, n_mixed, 48), KEYS, "left_semi")
        firsts = rows.groupBy(*KEYS, "__text").agg(F.min("__id").alias("__first"))
        out = out.unionByName(masked(rows).join(firsts, [*KEYS, "__text"]).drop("__text"))
    return out.withColumn("__mask", F.col("__mask") + bit).drop("__first")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic."""
    told = labels.select(F.col("doc_id").cast("long").alias("__id"), (F.col("quality") == 1).alias("__good"), (F.col("toxic") == 1).alias("__toxic")).filter("__good or __toxic")
    told = told.groupBy("__id").agg(F.max("__good").alias("__good"), F.max("__toxic").alias("__toxic"))
    number = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return rows.join(told, "__id", "left").groupBy(F.col("__part").alias("part"), F.col("__mask").alias("mask")).agg(F.count("*").alias("n"), number("__good").alias("good"), number("__toxic").alias("toxic"))


def interactions(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """A row a part, order of the filters and step, from the counts of masks: bit k of a mask is set where filter names[k] fails."""
    orders = ["".join(p) for p in permutations(names)]
    bit = lambda letter: sum((F.when(letter == x, 1 << k).otherwise(0) for k, x in enumerate(names)), F.lit(0))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic", F.bit_count("mask").alias("m"))).alias("masks"))
    steps = by_part.select("part", "masks", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.lit(list(range(1, len(names) + 1)))).alias("step"))
    letter = lambda k: F.substr(F.col("filter_order"), F.lit(k), F.lit(1))
    before = sum((F.when(F.col("step") > k, bit(letter(k))).otherwise(0) for k in range(1, len(names))), F.lit(0))
    steps = steps.select("*", bit(F.substr(F.col("filter_order"), F.col("step"), F.lit(1))).alias("own"), before.alias("before"))
    meets = lambda x, c: x["mask"].bitwiseAND(F.col(c)) != 0

    def total(value: str, rule) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(rule(x), x[value]).otherwise(0))

    here = lambda x: meets(x, "own") & ~meets(x, "before")
    first = F.lit(len(orders)).cast("long")
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(meets(x, "own"), x["n"] * F.floor(first / F.greatest(x["m"], F.lit(1)))).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda x: ~meets(x, "own") & ~meets(x, "before")).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda x: meets(x, "own") & meets(x, "before")).alias("redundant"), total("n", lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    keyed = with_keys(docs)
    features = staged(masked(keyed).drop("__text"), "features")
    return interactions(mask_counts(later_copies(keyed, features), labels))

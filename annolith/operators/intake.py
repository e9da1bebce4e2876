"""The audit of a staged source against a dataset: five checks from one grouping by image and one by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import privacy_findings
from .splits import spanning

#: Bits a staged hash, and words of 64 bits that a sieve has at most: 2**20 words are broadcast in some 40 MB.
BITS_A_HASH, MOST_WORDS = 16, 1 << 20


def _word_and_bit(sha: Column, n_words: int) -> tuple[Column, Column]:
    h = F.xxhash64(sha)
    return h.bitwiseAND(n_words - 1), F.shiftrightunsigned(h, 40).bitwiseAND(63).cast("int")


def hash_sieve(hashes: DataFrame, column: str = "sha256") -> tuple[DataFrame, int]:
    """(word, bits) of a bit set that holds every hash, and its number of words: by their counted number, MOST_WORDS at most."""
    wanted = hashes.count() * BITS_A_HASH // 64
    n_words = min(MOST_WORDS, 1 << max(4, wanted.bit_length()))
    word, bit = _word_and_bit(F.col(column), n_words)
    one = F.expr("shiftleft(1L, __bit)")
    return hashes.filter(F.col(column).isNotNull()).select(word.alias("word"), bit.alias("__bit")).groupBy("word").agg(F.bit_or(one).alias("bits")), n_words


def sieve_marked(rows: DataFrame, sieve: DataFrame, n_words: int, column: str, name: str) -> DataFrame:
    """rows with the boolean `name`: whether the column's value may be in the sieve. False is certain, and is decided on the scan, before any shuffle."""
    word, bit = _word_and_bit(F.col(column), n_words)
    marked = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(sieve.withColumnsRenamed({"word": "__word", "bits": "__bits"})), "__word", "left")
    return marked.withColumn(name, F.expr("coalesce(__bits & shiftleft(1L, __bit), 0L) <> 0")).drop("__word", "__bit", "__bits")


def sieved(rows: DataFrame, sieve: DataFrame, n_words: int, column: str = "sha256") -> DataFrame:
    """Rows whose value may be in the sieve: all that are in it, and few others."""
    return sieve_marked(rows, sieve, n_words, column, "__maybe").filter("__maybe").drop("__maybe")


def content_findings(staged: DataFrame, dataset: DataFrame) -> DataFrame:
    """(image, check, detail) of staged images (image, sha256) whose bytes the dataset has, or another staged image.

    A dataset of any size is scanned once; only what passes the sieve is shuffled.
    """
    sieve, n_words = hash_sieve(staged)
    known = sieved(dataset.select("image", "sha256"), sieve, n_words).groupBy("sha256").agg(F.max("image").alias("known_as"))
    own = staged.filter(F.col("sha256").isNotNull())
    several = own.groupBy("sha256").agg(F.count("*").alias("n"), F.min("image").alias("first"))
    told = several.join(known, "sha256", "left").filter("n > 1 OR known_as IS NOT NULL")
    checks = F.array(
        F.when(F.col("known_as").isNotNull(), F.struct(F.lit("already_in_dataset").alias("check"), F.col("known_as").cast("string").alias("detail"))),
        F.when(F.col("n") > 1, F.struct(F.lit("duplicate").alias("check"), F.col("first").cast("string").alias("detail"))),
    )
    listed = own.join(told, "sha256").select("image", F.explode(checks).alias("c"))
    return listed.filter("c is not null").select("image", "c.check", "c.detail")


def coverage_findings(staged: DataFrame, rows: DataFrame, review: DataFrame, groups: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image, check, detail) of what staged images lack and what annotation rows lack, and (group, split) of all images that have both.

    rows: image, is_synthetic (boolean). The five tables meet in one grouping by image: one shuffle, partly
    aggregated before it, so that an image of very many rows costs a row a task.
    """
    null = lambda kind: F.lit(None).cast(kind)

    def tagged(df: DataFrame, source: str, **values: Column) -> DataFrame:
        kinds = {"synthetic": "boolean", "group": "string", "split": "string"}
        return df.select("image", F.lit(source).alias("source"), *(values.get(c, null(k)).cast(k).alias(c) for c, k in kinds.items()))

    every = tagged(staged, "staged").unionByName(tagged(rows, "row", synthetic=F.col("is_synthetic"))).unionByName(tagged(review, "review"))
    every = every.unionByName(tagged(groups, "group", group=F.col("group"))).unionByName(tagged(splits, "split", split=F.col("split")))
    has = lambda source: F.max(F.col("source") == source)
    merged = every.groupBy("image").agg(has("staged").alias("staged"), has("row").alias("annotated"), F.max("synthetic").alias("synthetic"), has("review").alias("reviewed"), F.max("group").alias("group"), F.max("split").alias("split"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = {
        "not_annotated": F.col("staged") & ~F.col("annotated"), "annotation_without_image": ~F.col("staged") & F.col("annotated"), "synthetic_row": F.col("staged") & F.coalesce("synthetic", F.lit(False)),
        "not_reviewed": F.col("staged") & ~F.col("reviewed"), "no_group": F.col("staged") & blank("group"), "no_split": F.col("staged") & blank("split"),
    }
    found = merged.select("image", F.explode(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))).alias("check")).filter("check is not null")
    return found.select("image", "check", F.lit("").alias("detail")), merged.filter(~blank("group") & ~blank("split")).select("group", "split")


def staged_source_audit(staged: DataFrame, dataset: DataFrame, rows: DataFrame, review: DataFrame, groups: DataFrame, splits: DataFrame) -> DataFrame:
    """(image, check, detail): content against itself and the dataset, annotation, privacy, groups and splits of staged images (image, sha256).

    rows: image, is_synthetic; review: image and what privacy_findings() reads; groups: image, group; splits: image, split.
    Findings of a group have no image and name the group in detail.
    """
    lacking, assigned = coverage_findings(staged, rows, review, groups, splits)
    privacy = privacy_findings(staged, review).filter("finding <> 'not reviewed'").select("image", F.lit("privacy").alias("check"), F.col("finding").alias("detail"))
    spans = spanning(assigned, "group").select(F.lit(None).cast(staged.schema["image"].dataType).alias("image"), F.lit("group_spans_splits").alias("check"), F.col("group").alias("detail"))
    return content_findings(staged, dataset).unionByName(lacking).unionByName(privacy).unionByName(spans)


def audit_counts(findings: DataFrame) -> DataFrame:
    """(check, images): what blocks a source, by check."""
    return findings.groupBy("check").agg(F.count("*").alias("findings"), F.count_distinct("image").alias("images"))

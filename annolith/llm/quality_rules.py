"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio.

Unigrams and bigrams are hashed into counters, once over the trusted target (all
documents that `labels` marks as good) and once over the whole raw corpus. The
number of counters grows with the square root of the corpus' bytes. A document's score
is the mean over its n-grams of ln(p_target / p_raw), both multinomials smoothed in the same
proportion and the raw count less the document's own n-gram; so what a document alone says
is no evidence for or against it. It is kept if its base rules hold and the score reaches THRESHOLD.

Words are exploded within the scan and summed by row before anything is shuffled, so hashing, lookup
and sums are compiled code and a document travels as one row of numbers. Up to IN_ARRAY counters
the ratios go to the tasks as one array; more are joined by a shuffle of each document's distinct n-grams.

Edge cases: null and blank texts have no words, fail the base rule and score 0;
null doc_ids match no label; repeated rows are judged alike; an empty corpus or no trusted document at all makes
all ratios 0, so only the base rules decide; extra columns, of any name, are ignored by
judge() and kept by keep_good().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense, small, staged, words

#: Counters, at least; a power of two.
BUCKETS = 1 << 16
#: Counters for each square root of a byte of text.
PER_ROOT_BYTE = 16
#: Counters whose ratios are held as one array, 4 bytes each, by every task.
IN_ARRAY = 1 << 24
#: Added to every counter of the target, and as much in proportion to every raw one.
SMOOTHING = 1.0
#: Least mean log-likelihood ratio of an n-gram.
THRESHOLD = -0.25
MIN_WORDS = 10
WINDOW = 5
#: Percentage of words in repeated windows above which a document fails.
MAX_REPEATED = 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counters_for(docs: DataFrame) -> int:
    """The number of counters for a corpus: the power of two at or above PER_ROOT_BYTE roots of its bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(BUCKETS, 1 << int(PER_ROOT_BYTE * size**0.5).bit_length())


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__w", words(F.col("text"))).withColumn("__n", F.size("__w"))


def _pairs(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """keys and, a row a word: the counters of the word and of the bigram that it begins, null for the last word; a row of nulls for a text without words."""
    after = F.slice("__w", F.lit(2), F.greatest(F.col("__n") - 1, F.lit(0)))
    each = df.select(*keys, F.explode_outer(F.arrays_zip(F.col("__w").alias("a"), after.alias("b"))).alias("__p")).select(*keys, F.col("__p.a").alias("a"), F.col("__p.b").alias("b"))
    # the hash skips nulls, so that of a pair without its second word must be left out
    at = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    return each.select(*keys, F.when(F.col("a").isNotNull(), at("a")).alias("one"), F.when(F.col("b").isNotNull(), at("a", "b")).alias("two"))


def _grams(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """keys and `bucket`, a row an n-gram."""
    return _pairs(df, buckets, *keys).select(*keys, F.explode(F.array("one", "two")).alias("bucket")).filter("bucket is not null")


def counted(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, good): n-grams of the corpus and of its trusted documents by counter, staged."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id")).distinct()
    good = staged(good.withColumn("__good", F.lit(1)), "trusted-ids")
    marked = _with_words(docs.select("doc_id", "text")).join(small(good, good.count(), 24), F.col("doc_id") == F.col("__id"), "left")
    grams = _grams(marked.withColumn("__good", F.coalesce("__good", F.lit(0))), buckets, "__good")
    return staged(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__good").alias("good")), "counters")


def _ratio(tg: int, tr: int) -> Column:
    """A counter's ratio from its `good` and `raw`, 0 where no document is trusted."""
    if not tg:
        return F.lit(0.0).cast("float")
    # (good + a) / (tg + a B) over (raw - 1 + a tr / tg) / (tr + a B tr / tg): the totals cancel out
    others = F.greatest(F.coalesce(F.col("raw"), F.lit(0)) - 1, F.lit(0))
    return F.log((F.coalesce("good", F.lit(0)) + F.lit(SMOOTHING)) / (others * F.lit(tg / tr) + F.lit(SMOOTHING))).cast("float")


def _totals(counters: DataFrame) -> tuple[int, int]:
    return tuple(counters.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0))).first())


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: `ratios`, an array of ln(p_target / p_raw) by counter, 4 bytes each."""
    return _as_array(counted(docs, labels, buckets), buckets)


def _as_array(counters: DataFrame, buckets: int) -> DataFrame:
    return dense(counters, "bucket", _ratio(*_totals(counters)), buckets).withColumnRenamed("values", "ratios")


def _repeated_words(n: Column) -> Column:
    """Words covered by the 5-word windows whose hash occurs twice or more, from the columns __h (hashes by position) and __n."""
    at = F.array_sort(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sortd = F.col("__s")
    same = F.filter(sortd, lambda x, k: (
        F.coalesce(F.get(sortd, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sortd, k + 1)["h"] == x["h"], F.lit(False))
    ))
    starts = F.col("__p")
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum"), p.alias("last")),
    )["sum"]
    return at, F.sort_array(F.transform(same, lambda x: x["i"])), covered


def statistics(docs: DataFrame) -> DataFrame:
    """docs with __w, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; all of it inside one scan, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = _with_words(docs)
    # A window is the hash of its words' hashes; they are zipped first, so that the lambdas hold nothing but a hash.
    df = df.withColumn("__v", F.transform("__w", lambda x: F.xxhash64(x)))
    shifted = [F.slice("__v", F.lit(k + 1), F.greatest(F.col("__n") - WINDOW + 1, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    hashes = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(x))
    df = df.withColumn("__h", F.when(F.col("__n") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    # Only documents with an equal pair of windows are sorted; each array is a column of its own so that no lambda recomputes it.
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    at, same, covered = _repeated_words(F.col("__n"))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("__s", F.when(twice, at).otherwise(empty))
    df = df.withColumn("__p", F.when(F.size("__s") > 0, same).otherwise(F.array().cast("array<int>")))
    bare = text
    for c in " \n\t\r\x0b\x0c":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    df = df.withColumn("__lines", lines)
    return df.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("__p") > 0, covered).otherwise(F.lit(0)).cast("long"),
    }).drop("__v", "__h", "__s", "__p", "__lines")


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int | None, *keys: str) -> DataFrame:
    """keys, functions of a row that are cheap to carry, the counts, the ratio and the verdicts of every row."""
    buckets = buckets or counters_for(docs)
    counters = counted(docs, labels, buckets)
    table = statistics(docs.select("text", *keys)).withColumn("__i", F.monotonically_increasing_id())
    carried = [*keys, *COUNTS]
    if buckets <= IN_ARRAY:
        at = lambda c: F.coalesce(F.get(F.col("__r"), F.col(c)).cast("double"), F.lit(0.0))
        ratios = _as_array(counters, buckets).scalar()
        each = _pairs(table, buckets, "__i", *carried).withColumn("__r", ratios)
        summed = each.groupBy("__i").agg(F.sum(at("one") + at("two")).alias("__sum"), *(F.first(c).alias(c) for c in carried))
    else:
        rows = staged(table.select("__i", "__w", "__n", *carried), "word-rows")
        met = _grams(rows, buckets, "__i").groupBy("__i", "bucket").agg(F.count("*").alias("__m")).join(counters.select("bucket", _ratio(*_totals(counters)).alias("ratio")), "bucket")
        sums = met.groupBy("__i").agg(F.sum(F.col("__m") * F.col("ratio").cast("double")).alias("__sum"))
        summed = rows.drop("__w", "__n").join(sums, "__i", "left")
    n = F.col("n_words")
    grams = F.when(n >= 2, 2 * n - 1).otherwise(n)
    df = summed.withColumn("llr", F.when(n > 0, F.round(F.col("__sum") / grams, 6)).otherwise(F.lit(0.0)))
    df = df.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the mean log-likelihood ratio."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(narrow, labels, threshold, buckets, "doc_id").select("doc_id", *COUNTS, "base_failed", "kept", "llr")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None) -> DataFrame:
    """docs without the documents that judge() rejects.

    A verdict follows from the text, so rejected texts are known by 128 bits of hash and no text is shuffled
    while their hashes are few enough to broadcast.
    """
    mark = lambda t: (F.xxhash64(t), F.xxhash64(F.lit("quality"), F.length(t), t))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("doc_id", t.alias("text"), mark(t)[0].alias("__m1"), mark(t)[1].alias("__m2"))
    judged = _scored(marked, labels, threshold, buckets, "__m1", "__m2")
    bad = staged(judged.filter(~F.col("kept")).select("__m1", "__m2").distinct(), "rejected-texts")
    row = docs.select(*(m.alias(f"__m{k + 1}") for k, m in enumerate(mark(t))), F.struct(*(F.col(c) for c in docs.columns)).alias("__row"))
    kept = row.join(small(bad, bad.count(), 32), ["__m1", "__m2"], "left_anti")
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns))

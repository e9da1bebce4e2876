"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Two words are one edit apart if deleting one code point at the same place of
both gives one string (a replacement), or if deleting one of the longer gives
the shorter (an insertion or a deletion). So every word sends the hashes of
all its single deletions, and its own; NumPy takes them from prefix and suffix
hashes, whole batches at a time, a constant time each however long the word.

Keys are 64-bit integers with the word's id, length and place. They are dealt by their
top bits, in as many radix buckets as the counted keys need, and each bucket is
sorted by NumPy: equal keys are neighbours, and keys that nothing shares, nearly all of them, end there. What
is left meets its strings, and the strings decide: a collision of hashes never
links two words.

Groups are small by construction, never by a cap: the words that share a
deletion at one place differ in one letter of a fixed alphabet (90 of them), and a word has 90 longer ones a
place at most. A group is folded into counts and its best words, so no pairs
are made. A group's strings travel, not those of all keys.

Edge cases: null and blank texts have no words; a null doc_id stands as an empty string before the colon; a run
that loses its only letter is no word; words of any length are taken, in time linear in it; of words equally
frequent the first in code-point order is the form; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, staged, weighed
from .textbytes import BASE, flushes, mixed, powers, trim

RUN = re.compile("[a-zÀ-ÿ]+")
#: One of so many runs of a document loses a letter.
DAMAGED = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as the word.
TIMES = 10
FLUSH = 4 << 20
#: Distinct runs that a task counts before it hands them on.
COUNTED = 200_000
#: Keys of a radix bucket, about, and code points whose keys a worker makes at once.
BUCKET_KEYS, AT_ONCE = 500_000, 1 << 18
#: Buckets for each task of the shuffle at least.
EACH = 8
U = np.uint64


def _runs(text: bytes) -> Counter:
    """The runs of letters long enough to matter, with A-Z (and no other letter) in lower case."""
    return Counter(r for r in RUN.findall(text.lower().decode()) if len(r) >= LEAST_LENGTH)


def damaged(prefix: int, run: str) -> str:
    """The run, or what is left of it where the checksum deletes a letter. prefix: the checksum of the bytes before it."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % DAMAGED else run[: (k := h % len(run))] + run[k + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of LEAST_LENGTH code points and LEAST_COUNT occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for flush in flushes(batches, 1, FLUSH):
            for doc_id, text in zip(flush.column(0).to_pylist(), flush.column(1).cast(pa.binary()), strict=True):
                prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                for r, n in _runs(text.as_py() or b"").items():
                    w = damaged(prefix, r)
                    if len(w) >= LEAST_LENGTH:
                        held[w] = held.get(w, 0) + n
                if len(held) > COUNTED:
                    yield batch()
        if held:
            yield batch()
        trim()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, word and place of every deletion of every word and, at place -1, of the whole word.

    A word's hash is the sum of its letters' values times powers of a base; without the
    letter at a place it is the prefix before the place and the suffix after it, moved by one.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(letters)) - first[word]
    power, inverse = powers(int(lengths.max(initial=0)) + 1)
    with np.errstate(over="ignore"):
        value = mixed(letters.astype(U)) * power[place]
        total = np.concatenate((np.zeros(1, U), np.cumsum(value, dtype=U)))
        before = total[:-1] - total[first][word]
        after = total[(first + lengths)][word] - total[1:]
        keys = before + after * inverse[1]
        whole = total[first + lengths] - total[first]
    index = np.arange(len(words))
    # the length of what is left tells the shorter from the longer that hashes alike
    left = np.concatenate((lengths[word] - 1, lengths)).astype(U)
    key = mixed(np.concatenate((keys, whole)) ^ left * BASE)
    return key, np.concatenate((word, index)), np.concatenate((place, np.full(len(words), -1)))


def shared_keys(vocabulary: DataFrame) -> DataFrame:
    """key, id, length, place of the keys that may link words: those of one place that several words of one length have, and those of a whole word with the deletions that give it."""
    spark = vocabulary.sparkSession
    n_keys = vocabulary.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    parts = shuffle_width(spark)
    # as many buckets as the keys need, and some for every task however few there are
    bits = max((n_keys // BUCKET_KEYS).bit_length(), (EACH * parts - 1).bit_length())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            a = 0
            while a < len(words):
                b, size = a, 0
                while b < len(words) and (size < AT_ONCE or b == a):
                    size += len(words[b])
                    b += 1
                key, word, place = deletion_keys(words[a:b])
                length = np.fromiter(map(len, words[a:b]), np.int64, b - a)
                radix = (key >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
                out = [pa.array(radix), pa.array(key.astype(np.int64)), pa.array(ids[a:b][word]), pa.array(length[word].astype(np.int32)), pa.array(place.astype(np.int32))]
                for k in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in out], ["radix", "key", "id", "length", "place"])
                a = b

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by radix bucket; one bucket is held and sorted at a time."""
        held: list[np.ndarray] = []

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, ids, length, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((place, length, key))
            key, ids, length, place = key[order], ids[order], length[order], place[order]
            fresh = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0)
            size = np.diff(np.append(fresh, len(key)))
            same_place = np.zeros(len(key), bool)
            alike = (key[1:] == key[:-1]) & (length[1:] == length[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0)
            same_place[1:] |= alike
            same_place[:-1] |= alike
            whole = np.repeat(np.logical_or.reduceat(place < 0, fresh), size)
            keep = same_place | whole & np.repeat(size > 1, size)
            out = [pa.array(c[keep]) for c in (key, ids, length, place)]
            for k in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in out], ["key", "id", "length", "place"])

        at = None
        for batch in batches:
            radix, *columns = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(radix, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(radix)], strict=True):
                if radix[a] != at:
                    yield from settle()
                    at = radix[a]
                held.append(tuple(c[a:b] for c in columns))
        yield from settle()
        trim()

    keys = vocabulary.select("id", "word").mapInArrow(make, "radix int, key long, id long, length int, place int")
    return keys.repartition(parts, "radix").sortWithinPartitions("radix").mapInArrow(sort, "key long, id long, length int, place int")


def _verified(words: list[str], counts: list[int], places: list[int]) -> Iterator[tuple[int, int, int, str]]:
    """Row, near words, and the best of them, for the rows of one key: every string that the rows stand for is compared."""
    replaced: dict[tuple[str, int], list[int]] = {}
    longer: dict[str, dict[str, int]] = {}
    whole = {w: k for k, (w, p) in enumerate(zip(words, places, strict=True)) if p < 0}
    for k, (w, p) in enumerate(zip(words, places, strict=True)):
        if p >= 0:
            left = w[:p] + w[p + 1 :]
            replaced.setdefault((left, p), []).append(k)
            if left in whole:
                longer.setdefault(left, {}).setdefault(w, k)
    rank = lambda k: (-counts[k], words[k])
    for rows in replaced.values():
        if len(rows) > 1:
            first, second = sorted(rows, key=rank)[:2]
            for k in rows:
                best = second if k == first else first
                yield k, len(rows) - 1, counts[best], words[best]
    for short, rows in longer.items():
        best = min(rows.values(), key=rank)
        yield whole[short], len(rows), counts[best], words[best]
        for k in rows.values():
            yield k, 1, counts[whole[short]], short


def near(vocabulary: DataFrame, found: DataFrame) -> DataFrame:
    """id, n_near, best_n, best: the number of near words of each word that has any, and the first of them by count and code points."""
    parts = shuffle_width(vocabulary.sparkSession)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""
        at, held, out = None, [], []

        def settle() -> None:
            if held:
                ids, words, counts, places = zip(*held, strict=True)
                out.extend((ids[k], n, m, w) for k, n, m, w in _verified(words, counts, places))
                held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["id", "n_near", "best_n", "best"])
            out.clear()
            return made

        for rows in batches:
            for key, *row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if key != at:
                    settle()
                    at = key
                    if len(out) > 20_000:
                        yield batch()
                held.append(row)
        settle()
        if out:
            yield batch()

    strings = found.join(vocabulary, "id").select("key", "id", "word", "n", "place")
    told = strings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(verify, "id long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best"))).alias("best")
    return told.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form: the end of its chain, by pointer doubling. A form is TIMES as frequent, so chains are short."""
    chain = staged(forms.select("word", F.col("form").alias("root")), "chain")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(chain.join(weighed(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        moved = step.filter("moved").limit(1).count()
        chain = step.select("word", "root")
        if not moved:
            return chain


def groups(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and their counts (word, n)."""
    vocabulary = staged(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n", F.length("word").alias("length")), "vocabulary")
    told = near(vocabulary, shared_keys(vocabulary))
    rows = vocabulary.join(told, "id", "left").withColumn("is_form", F.col("best_n") >= TIMES * F.col("n"))
    rows = staged(rows.select("word", F.when(F.col("is_form"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n")), "near")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Removal of byte strings that occur twice, by distributed prefix doubling.

A document is its UTF-8 bytes. The string of LENGTH bytes from a position is
repeated if it starts anywhere else too. Ranks are never given to all
positions: consecutive positions are one row as long as they share their anchor,
the leftmost place of the least hash among the GRAM-byte strings inside their LENGTH bytes.
Equal strings have equal anchors at equal offsets, as that is decided by their bytes alone.

1. A row begins as the anchor's GRAM bytes, which all its positions' strings hold. Spark groups
   rows by these; a row whose bytes nothing else has is unique, all its positions with it, and ends.
2. The rows that are left get the rank of their class. Offsets grow: positions
   are split by their distance from the anchor into quarters, so that the bytes
   that a quarter's strings share are longer (145, 337, 385, 397, 400). A pair of the rank and
   the added bytes' hash is grouped and ranked anew, until it is unique or LENGTH bytes long.
3. Rows of a class that agree in all bytes of all their positions are past the threshold at
   once: their positions are repeated. One of them goes on as a partner of rows
   that differ, without more copies, so that a class of thousands of copies costs one row.

Only rows between unique and equal, those at the ends of what is repeated, go on, with their own 400 to 655 bytes of text.
The places found go back to the documents, which drop the bytes they cover.

Equality: of anchors by 128 bits of hash, of what is added by 64 bits within the class of a rank.

Edge cases: null and blank texts have no bytes to compare (a null text is empty); texts below LENGTH bytes lose nothing; rows of
equal doc_id are documents of their own and are told apart by their texts; a null doc_id is a document like any other; texts are
read whole, in pieces of bounded size; a text of one letter has an anchor a byte, counted once a piece; kept bytes may be no
valid UTF-8, so only their hash is returned (and the bytes, if asked for); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intake import hash_sieve, sieve_marked, sieved
from .common import staged
from .textbytes import BASE, flushes, mixed, powers, sliding_min, trim

LENGTH = 400
#: Positions by offset from their anchor: 0 to OFFSETS - 1; the bytes of an anchor are those that all of their strings hold.
OFFSETS = 256
GRAM = LENGTH - OFFSETS + 1
#: Positions of a row by round: quarters of the one before.
SPANS = (256, 64, 16, 4, 1)
#: Bytes of text that a worker takes at once, and positions of a piece of it (places take 20 bits).
FLUSH, PIECE = 1 << 20, 1 << 19
U = np.uint64

_rng = np.random.default_rng(4_001_145)
#: Values of the bytes for two independent hashes.
BYTE_VALUES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)

ROWS = "kind int, doc_id long, of long, at long, lo int, hi int, h1 long, h2 long, whole long, n int"
CHILD = "doc_id long, of long, at long, lo int, hi int, rank long, node int, added long, whole long, n int, bytes binary"


class _Hashes:
    """Hashes of any parts of a piece of bytes, in constant time each."""

    def __init__(self, raw: np.ndarray, which: int):
        self.inverse = powers(len(raw) + 1)[1]
        with np.errstate(over="ignore"):
            value = BYTE_VALUES[which][raw] * powers(len(raw) + 1)[0][: len(raw)]
            self.total = np.zeros(len(raw) + 1, U)
            np.cumsum(value, out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[end] - self.total[begin]) * self.inverse[begin])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, least and largest offset of its positions, two hashes of its bytes and one of all its positions' bytes, of a piece that holds documents up to `ends`."""
    n = len(raw) - LENGTH + 1
    nothing = np.empty(0, np.int64)
    if n <= 0:
        return (nothing,) * 6
    position = np.arange(n)
    document = np.searchsorted(ends, position, "right")
    valid = position + LENGTH <= ends[document]
    first = _Hashes(raw, 0)
    place = np.arange(len(raw) - GRAM + 1)
    low = U((1 << 20) - 1)
    value = first.of(place, place + GRAM) & ~low | place.astype(U)
    anchor = (sliding_min(value, OFFSETS) & low).astype(np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (document[1:] != document[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], n) - 1
    good = valid[begin]
    begin, end = begin[good], end[good]
    at = anchor[begin]
    second = _Hashes(raw, 1)
    return at, at - end, at - begin, first.of(at, at + GRAM), second.of(at, at + GRAM), second.of(begin, end + LENGTH)


def _merged(document: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that meet or overlap as one; documents' ranges stay apart."""
    order = np.lexsort((begin, document))
    document, begin, end = document[order], begin[order], end[order]
    gap = np.int64(1) << 40
    reach = np.maximum.accumulate(end + document * gap)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] + document[1:] * gap > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begin)) - 1
    return document[first], begin[first], (reach[last] - document[first] * gap)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: anchors; equal ones of a piece once, with n = 2. Rows of kind 1: places (lo, hi: none) that those repeat, from `at` on, `n` bytes."""
    for flush in flushes(batches, 1, FLUSH):
        ids, marks = flush.column(0).combine_chunks(), np.asarray(flush.column(2))
        texts = [t.as_py() or b"" for t in flush.column(1).cast(pa.binary())]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = np.frombuffer(b"".join(texts), np.uint8)
        for s in range(0, max(1, len(raw)), PIECE):
            piece = raw[s : s + PIECE + LENGTH - 1]
            at, lo, hi, h1, h2, whole = anchors(piece, np.append(ends - s, np.iinfo(np.int64).max >> 1))
            if not len(at):
                continue
            document = np.searchsorted(ends, at + s, "right")
            own = at + s - starts[document]
            with np.errstate(over="ignore"):
                key = mixed(h1 ^ mixed(h2 ^ mixed(whole ^ ((hi.astype(U) << U(9)) | lo.astype(U)))))
            _, index, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(index), np.int32)), ids.take(pa.array(document[index])), pa.array(marks[document[index]]), pa.array(own[index]), pa.array(lo[index].astype(np.int32)), pa.array(hi[index].astype(np.int32)),
                    pa.array(h1[index].astype(np.int64)), pa.array(h2[index].astype(np.int64)), pa.array(whole[index].astype(np.int64)), pa.array(np.minimum(count, 2).astype(np.int32)),
                ],
                ["kind", "doc_id", "of", "at", "lo", "hi", "h1", "h2", "whole", "n"],
            )
            again = count[back] > 1
            if again.any():
                which, begin, end = _merged(document[again], (own - hi)[again], (own - lo + LENGTH)[again])
                none, zero = pa.nulls(len(which), pa.int32()), pa.nulls(len(which), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(which), np.int32)), ids.take(pa.array(which)), pa.array(marks[which]), pa.array(begin), none, none, zero, zero, zero, pa.array((end - begin).astype(np.int32))],
                    ["kind", "doc_id", "of", "at", "lo", "hi", "h1", "h2", "whole", "n"],
                )
        trim()


def _quarters(doc_id, of, at: int, lo: int, hi: int, rank: int, n: int, text: bytes, span: int) -> Iterator[tuple]:
    """The parts of a row by offset, `span` offsets each. text: the bytes of all its positions, from offset hi on."""
    for node in range(lo // span, hi // span + 1):
        a, b = max(lo, node * span), min(hi, (node + 1) * span - 1)
        own = text[hi - b : hi - a + LENGTH]
        # what all offsets of the quarter share, whichever of them this row has: it begins at the least and ends with the largest
        shared = own[b - node * span : len(own) - ((node + 1) * span - 1 - a)]
        yield doc_id, of, at, a, b, rank, node, _signed(shared), _signed(own + bytes((a - node * span, b - node * span))), n, own


def _signed(text: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _children(rows: Iterator[tuple], span: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = ["doc_id", "of", "at", "lo", "hi", "rank", "node", "added", "whole", "n", "bytes"]
    out: list[tuple] = []
    for row in rows:
        out += _quarters(*row, span)
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
    trim()


KEY = ["rank", "node", "added"]


def _ranked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Places that are repeated for certain, and the rows that go on, each with the new rank of its class. Rows of unique classes are in neither.

    Most rows are unique. Only the hashes of their pairs are shuffled to tell that; a sieve of those that occur twice then holds the others back on the scan.
    """
    paired = rows.withColumn("__pair", F.xxhash64(*KEY))
    again = staged(paired.groupBy("__pair").agg(F.sum("n").alias("m")).filter("m > 1").select("__pair"), f"{name}-pairs")
    sieve, n_words = hash_sieve(again, "__pair")
    likely = sieved(paired, staged(sieve, f"{name}-sieve"), n_words, "__pair").drop("__pair")
    alike = likely.groupBy(*KEY, "whole").agg(F.sum("n").alias("m"), F.min(F.struct("doc_id", "of", "at")).alias("lead"))
    alike = staged(alike, f"{name}-alike")
    classes = alike.groupBy(*KEY).agg(F.sum("m").alias("all"), F.count("*").alias("kinds")).filter(F.col("all") > 1)
    classes = staged(classes.select(*KEY, F.col("kinds") > 1, F.monotonically_increasing_id().alias("new")).toDF(*KEY, "several", "new"), f"{name}-ranks")
    shared = staged(alike.join(classes, KEY), f"{name}-shared")
    met = staged(likely.join(shared, [*KEY, "whole"]), f"{name}-met")
    repeated = met.filter("m > 1").select("doc_id", "of", (F.col("at") - F.col("hi")).alias("begin"), (F.col("at") - F.col("lo") + LENGTH).alias("end"))
    lead = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.of") == F.col("of")) & (F.col("lead.at") == F.col("at"))
    onward = met.filter(F.col("several") & lead).select("doc_id", "of", "at", "lo", "hi", F.col("new").alias("rank"), F.least("m", F.lit(2)).cast("int").alias("n"), *(["bytes"] if "bytes" in rows.columns else []))
    return repeated, onward


def repeated_places(docs: DataFrame) -> DataFrame:
    """doc_id, of (the text's hash), begin, end: byte ranges of strings of LENGTH bytes that start twice or more. Ranges may overlap. docs: doc_id, text, of."""
    scanned = staged(docs.mapInArrow(_scan, ROWS), "anchors")
    places = [scanned.filter("kind = 1").select("doc_id", "of", F.col("at").alias("begin"), (F.col("at") + F.col("n")).alias("end"))]
    rows = scanned.filter("kind = 0").select("doc_id", "of", "at", "lo", "hi", F.col("h1").alias("rank"), F.lit(0).alias("node"), F.col("h2").alias("added"), F.xxhash64("whole", "lo", "hi").alias("whole"), "n")
    repeated, onward = _ranked(rows, "round-0")
    places.append(repeated)

    onward = staged(onward.distinct(), "onward")
    if onward.isEmpty():
        return places[0].unionByName(repeated)
    # the rows of a document meet its text once, which is cut where they are; a row carries its own bytes from here on
    by_text = staged(onward.groupBy("doc_id", "of").agg(F.collect_list(F.struct("at", "lo", "hi", "rank", "n")).alias("rows")), "onward-by-text")
    met, _ = _with_rows(docs, by_text)
    met = met.select("doc_id", "of", "rows", "text")
    rows = met.mapInArrow(lambda batches: _children(_cut(batches), SPANS[1]), CHILD)
    if docs.groupBy("doc_id", "of").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "of", "at", "lo", "hi"])  # rows of one id and text have the same anchors
    for k, span in enumerate(SPANS[1:], 1):
        rows = staged(rows, f"round-{k}")
        repeated, onward = _ranked(rows, f"round-{k}")
        places.append(repeated)
        if span == 1 or onward.isEmpty():
            break
        rows = onward.mapInArrow(lambda batches, to=SPANS[k + 1]: _children(_rows(batches), to), CHILD)
    return reduce(DataFrame.unionByName, places)


def _with_rows(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among a staged table's, of one row for each doc_id (null included) and text, with its columns; and docs that are not.

    A sieve of the table's documents decides on the scan, so that only texts that have rows, and few others, are shuffled.
    """
    keyed = rows.withColumn("__key", F.xxhash64("doc_id", "of"))
    sieve, n_words = hash_sieve(keyed, "__key")
    told = sieve_marked(docs.withColumn("__key", F.xxhash64("doc_id", "of")), staged(sieve, "documents-sieve"), n_words, "__key", "__maybe").drop("__key")
    other = rows.withColumnsRenamed({"doc_id": "__id", "of": "__of"})
    met = told.filter("__maybe").join(other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), "left")
    return met, told.filter("NOT __maybe")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each document with the bytes of all their positions; texts are taken a flush at a time and never as strings."""
    for flush in flushes(batches, 3, FLUSH):
        flush = flush.filter(pc.is_valid(flush.column(2)))
        rows = flush.column(2).combine_chunks()
        at, lo, hi, rank, n = (np.asarray(rows.flatten().field(k)).tolist() for k in ("at", "lo", "hi", "rank", "n"))
        k = 0
        for doc_id, of, count, text in zip(flush.column(0).to_pylist(), flush.column(1).to_pylist(), rows.value_lengths().to_pylist(), flush.column(3).cast(pa.binary()), strict=True):
            text = memoryview(text.as_buffer())
            for j in range(k, k + count):
                yield doc_id, of, at[j], lo[j], hi[j], rank[j], n[j], bytes(text[at[j] - hi[j] : at[j] - lo[j] + LENGTH])
            k += count


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            yield from zip(*(c.slice(k, 1000).to_pylist() for c in batch.columns), strict=True)


def keep(text: bytes, begin: list[int], end: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and the bytes that are left."""
    if not begin:
        return 0, 0, text
    _, begin, end = _merged(np.zeros(len(begin), np.int64), np.asarray(begin, np.int64), np.asarray(end, np.int64))
    edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return int((end - begin).sum()), len(begin), kept


def removed(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("of"))
    ranges = repeated_places(narrow).distinct().groupBy("doc_id", "of").agg(F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches, 1, FLUSH):
            texts = [t.as_py() for t in flush.column(1).cast(pa.binary())]
            out = [keep(t, a or [], b or []) for t, a, b in zip(texts, flush.column(2).to_pylist(), flush.column(3).to_pylist(), strict=True)]
            columns = [
                flush.column(0).combine_chunks(), pa.array(map(len, texts), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), *([pa.array([x[2] for x in out], pa.binary())] if keep_bytes else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if keep_bytes else [])])

    held, free = _with_rows(narrow, staged(ranges, "ranges"))
    none = F.lit(None).cast("array<long>")
    rows = held.select("doc_id", "text", "begin", "end").unionAll(free.select("doc_id", "text", none, none))
    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_bytes)

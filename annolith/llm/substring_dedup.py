"""Substring dedup by super-k-mer partitioning.

A window is 13 consecutive words. Its minimiser is the least hash of its
three-word grams; consecutive windows of a document that share a minimiser
travel together as one packed string, a super-k-mer, to the minimiser's bucket,
so that equal windows always meet and most words travel about three times
instead of thirteen. A bucket sorts its windows by hash, checks the bytes of
those that are equal, and finds the smallest doc_id of each distinct window.
Windows of other documents are duplicates; their places go back to the
documents, which drop the words they cover.

Hot passages are aggregated before the shuffle: within a flush, an equal
packed string travels once, for the smallest doc_id that holds it, as the
larger ones are decided on the spot. A bucket receives at most one copy of a
string from every flush.

Hot minimisers are split: those that a sample of documents shows to fill a bucket of their own are
replaced by the hash of each window, so that their windows travel alone, to buckets of their own; and a task remembers
such windows between flushes and sends one again only for a smaller doc_id. The sample decides
where windows meet, never which are equal.

Edge cases: null and blank texts have no words and the hash of the empty
string; documents below 13 words lose nothing; rows of equal doc_id never
remove each other's words, and are told apart by their text; a null doc_id
counts as larger than any other; an empty table gives no rows; extra columns
are ignored by dedup().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width
from .textbytes import Words, flushes, grams, mixed, sliding_min, trim

WINDOW = 13
#: Words of the grams among which minimisers are chosen.
GRAM = 3
#: Bytes of text that a worker packs at once.
FLUSH = 5 << 20
#: Buckets a shuffle partition: the rows that a worker sorts at once shrink with it.
BUCKETS_EACH = 16
#: Documents, about, from which hot minimisers are told, and the share of a bucket's mean load above which one is hot.
SAMPLED, HOT = 20_000, 0.5
#: Distinct hot windows that a task remembers before it starts afresh.
REMEMBERED = 200_000
NULL_ID = int(np.iinfo(np.int64).max)
NONE = np.empty(0, np.uint64)

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PACKED = "bucket int, kind int, doc_id long, n_words long, blob binary"


_compressor: zstandard.ZstdCompressor | None = None


def _press(*parts) -> bytes:
    """Arrays and byte strings, each with its length, as one compressed blob."""
    global _compressor
    _compressor = _compressor or zstandard.ZstdCompressor(level=3)
    out = []
    for p in parts:
        p = p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes()
        out += [len(p).to_bytes(8, "little"), p]
    return _compressor.compress(b"".join(out))


def _loosen(blob: bytes) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    """Places where a new run begins."""
    return np.flatnonzero(flags)


def _windows(texts: list[bytes], hot: np.ndarray) -> tuple[bytes, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one buffer, its words, the places where each text's words end, each word's text, and by window its key and whether that is hot."""
    buffer = b"\n".join(texts) + b"\n"
    w = Words(buffer)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    word_ends = np.searchsorted(w.start, ends, "left")
    doc = np.repeat(np.arange(len(texts)), np.diff(word_ends, prepend=0))
    if len(doc) < WINDOW:
        return buffer, w, word_ends, doc, np.empty(0, np.uint64), np.empty(0, bool)
    least = sliding_min(grams(w.hash, GRAM), WINDOW - GRAM + 1)
    is_hot = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least if len(hot) else np.zeros(len(least), bool)
    if is_hot.any():
        least = np.where(is_hot, grams(w.hash, WINDOW), least)
    return buffer, w, word_ends, doc, least, is_hot


def pack(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], buckets: int, hot: np.ndarray = NONE, known: dict[bytes, int] | None = None) -> tuple[dict[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blobs of super-k-mers by bucket, and the places (row key, first word, end word) that are decided already.

    Texts have single spaces between words. keys is ids unless ids repeat.
    """
    order = np.argsort(ids, kind="stable")
    buffer, w, word_ends, doc, least, is_hot = _windows([texts[k] for k in order], hot)
    n_windows = len(least)
    nothing = np.empty(0, np.int64)
    if not n_windows:
        return {}, (nothing, nothing, nothing)
    inside = doc[:n_windows] == doc[WINDOW - 1 :]
    fresh = np.ones(n_windows, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:n_windows] != doc[: n_windows - 1]) | (inside[1:] != inside[:-1])
    first = _runs(fresh)
    last = np.append(first[1:], n_windows) - 1
    valid = inside[first]
    first, last = first[valid], last[valid]
    rank = doc[first]
    doc_start = np.concatenate(([0], word_ends[:-1]))[rank]
    begin, end = w.start[first].tolist(), w.end[last + WINDOW - 1].tolist()

    seen: dict[bytes, int] = {}
    strings: list[bytes] = []
    owner: list[int] = []
    held, whose, decided = [], [], []
    known = {} if known is None else known
    own = ids[order]
    for k, (a, b, d, again) in enumerate(zip(begin, end, rank.tolist(), is_hot[first].tolist(), strict=True)):
        s = buffer[a:b]
        if again:
            before = known.get(s, NULL_ID + 1)
            if before < own[d]:
                decided.append(k)
                continue
            if len(known) >= REMEMBERED:
                known.clear()
            known[s] = int(own[d])
        j = seen.setdefault(s, len(strings))
        if j == len(strings):
            strings.append(s)
            owner.append(d)
            held.append(k)
            whose.append(j)
        elif owner[j] == d or ids[order[owner[j]]] == ids[order[d]]:
            held.append(k)
            whose.append(j)
        else:
            decided.append(k)
    where = np.asarray(decided, np.int64)
    row_key = keys[order]
    done = (row_key[rank[where]], first[where] - doc_start[where], last[where] + WINDOW - doc_start[where])

    held_a, whose_a = np.asarray(held, np.int64), np.asarray(whose, np.int64)
    first_of = np.full(len(strings), -1, np.int64)
    first_of[whose_a[::-1]] = held_a[::-1]
    bucket = (mixed(least[first[first_of]]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(strings), np.int64)
    place[by] = np.arange(len(strings))
    held_order = np.argsort(place[whose_a], kind="stable")
    held_a, whose_a = held_a[held_order], whose_a[held_order]
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    held_cuts = np.searchsorted(place[whose_a], cuts)
    blobs = {}
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(strings)
        x, y = held_cuts[k], held_cuts[k + 1] if k + 1 < len(cuts) else len(held_a)
        blobs[int(bucket[by[a]])] = _press(
            b"\n".join(strings[j] for j in by[a:b]),
            (place[whose_a[x:y]] - a).astype(np.int32),
            own[rank[held_a[x:y]]],
            row_key[rank[held_a[x:y]]] if keys is not ids else b"",
            (first[held_a[x:y]] - doc_start[held_a[x:y]]).astype(np.int32),
        )
    return blobs, done


def duplicates(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row key, first word, end word) of the windows of one bucket that a smaller doc_id has too."""
    strings, which, ids, keys, starts, n = [], [], [], [], [], 0
    for blob in blobs:
        text, w, i, r, s = _loosen(blob)
        strings.append(text)
        which.append(np.frombuffer(w, np.int32).astype(np.int64) + n)
        ids.append(np.frombuffer(i, np.int64))
        keys.append(np.frombuffer(r or i, np.int64))
        starts.append(np.frombuffer(s, np.int32).astype(np.int64))
        n += text.count(b"\n") + 1
    buffer = b"\n".join(strings) + b"\n"
    del strings
    which, ids, keys, starts = np.concatenate(which), np.concatenate(ids), np.concatenate(keys), np.concatenate(starts)
    # All rows of a string in one flush have the same doc_id: its owner.
    owner = np.empty(n, np.int64)
    owner[which] = ids
    w = Words(buffer)
    stops = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 0x0A)
    string = np.repeat(np.arange(n), np.diff(np.searchsorted(w.start, stops), prepend=0))
    h = grams(w.hash, WINDOW)
    at = np.flatnonzero(string[: len(h)] == string[WINDOW - 1 :])
    dup, rep = _equal(buffer, w, at, h[at], owner[string[at]], exact=False)
    if dup is None:
        dup, rep = _equal(buffer, w, at, h[at], owner[string[at]], exact=True)
    if not len(dup):
        nothing = np.empty(0, np.int64)
        return nothing, nothing, nothing
    fresh = np.ones(len(dup), bool)
    fresh[1:] = (np.diff(dup) != 1) | (string[dup[1:]] != string[dup[:-1]])
    first = _runs(fresh)
    last = np.append(first[1:], len(dup)) - 1
    begin, end, s = dup[first], dup[last] + WINDOW, string[dup[first]]
    word0 = np.searchsorted(string, s)
    # Every row of the string gets the places.
    by = np.argsort(which, kind="stable")
    lo, hi = np.searchsorted(which[by], s, "left"), np.searchsorted(which[by], s, "right")
    times = hi - lo
    run = np.repeat(np.arange(len(s)), times)
    row = by[np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())]
    return keys[row], starts[row] + (begin - word0)[run], starts[row] + (end - word0)[run]


def _equal(buffer: bytes, w: Words, at: np.ndarray, h: np.ndarray, owner: np.ndarray, exact: bool):
    """Windows that a smaller owner has too, and that owner's window; None if hashes alone would mislead.

    exact: group by bytes instead of hashes.
    """
    if exact:
        code: dict[bytes, int] = {}
        text = (buffer[w.start[k] : w.end[k + WINDOW - 1]] for k in at)
        h = np.fromiter((code.setdefault(t, len(code)) for t in text), np.int64, len(at))
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = sorted_h[1:] != sorted_h[:-1]
    first = _runs(fresh)
    if not len(first):
        return at, at
    group = np.cumsum(fresh) - 1
    several = np.diff(np.append(first, len(order)))[group] > 1
    order, group = order[several], group[several]
    if not len(order):
        return at[:0], at[:0]
    by = np.lexsort((order, owner[order], group))
    order, group = order[by], group[by]
    lead = np.flatnonzero(np.diff(group, prepend=-1))
    leader = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
    if not exact:
        # Bytes are compared over runs of neighbours whose partners are neighbours too.
        k = np.argsort(order, kind="stable")
        a, b = at[order[k]], at[leader[k]]
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a) != 1) | (np.diff(b) != 1)
        i = _runs(new)
        j = np.append(i[1:], len(a)) - 1
        for a0, a1, b0, b1 in zip(w.start[a[i]].tolist(), w.end[a[j] + WINDOW - 1].tolist(), w.start[b[i]].tolist(), w.end[b[j] + WINDOW - 1].tolist(), strict=True):
            if a0 != b0 and buffer[a0:a1] != buffer[b0:b1]:
                return None, None
    dup = owner[order] > owner[leader]
    order, leader = order[dup], leader[dup]
    k = np.argsort(order, kind="stable")
    return at[order[k]], at[leader[k]]


def keep(text: bytes, ranges: np.ndarray) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept text; ranges: (first, end) of places to remove."""
    if not len(text):
        return 0, 0, b""
    if not len(ranges):
        return text.count(b" ") + 1, 0, text
    parts = text.split(b" ")
    delta = np.zeros(len(parts) + 1, np.int64)
    np.add.at(delta, ranges[:, 0], 1)
    np.add.at(delta, ranges[:, 1], -1)
    gone = np.cumsum(delta)[:-1] > 0
    return len(parts), int(gone.sum()), b" ".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _places(ids: np.ndarray, first: np.ndarray, end: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    part = _part(ids, parts)
    order = np.lexsort((first, ids, part))
    part, ids, first, end = part[order], ids[order], first[order], end[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for k, a in enumerate(cuts):
        b = cuts[k + 1] if k + 1 < len(cuts) else len(part)
        yield int(part[a]), _press(ids[a:b], first[a:b].astype(np.int32), end[a:b].astype(np.int32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "kind", "doc_id", "n_words", "blob"])


def _texts(flush: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids = np.asarray(flush.column(0).fill_null(int(NULL_ID)), np.int64)
    return ids, [b" ".join((t.as_py() or b"").split()) for t in flush.column(1).cast(pa.binary())]


def _keys(ids: np.ndarray, texts: list[bytes], repeated: bool) -> np.ndarray:
    """ids themselves, or if ids repeat a hash of id and text."""
    if not repeated:
        return ids
    salt = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts]
    return (mixed(ids.astype(np.uint64)) ^ np.asarray(salt, np.uint64)).astype(np.int64)


def hot_minimisers(narrow: DataFrame, buckets: int) -> np.ndarray:
    """Minimisers that, by a sample of about SAMPLED documents, have HOT of a bucket's mean load of windows or more, sorted; 1 / HOT a bucket at most."""
    total = narrow.count()
    sample = narrow.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(max(1, total // SAMPLED))) == 0) if total > SAMPLED else narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches, 1, FLUSH):
            _, texts = _texts(flush)
            *_, doc, least, _ = _windows(texts, NONE)
            key, n = np.unique(least[doc[: len(least)] == doc[WINDOW - 1 :]], return_counts=True) if len(least) else (NONE, NONE)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])
            trim()

    counts = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    found = counts.filter((F.col("n") > 1) & (F.col("n") >= whole * F.lit(HOT / buckets))).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).astype(np.uint64))


def removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    parts = shuffle_width(docs.sparkSession)
    buckets = parts * BUCKETS_EACH
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = bool(narrow.groupBy("doc_id").count().filter("count > 1").limit(1).count())

    hot = hot_minimisers(narrow, buckets)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for flush in flushes(batches, 1, FLUSH):
            ids, texts = _texts(flush)
            blobs, done = pack(ids, _keys(ids, texts, repeated), texts, buckets, hot, known)
            rows = [(b, 0, None, None, blob) for b, blob in blobs.items()]
            rows += [(b * BUCKETS_EACH, 1, None, b, blob) for b, blob in _places(*done, parts)]
            if rows:
                yield _batch(rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; kind 1 passes through to the documents' parts."""
        at, held, ready, found, n_found = None, [], [], [], 0

        def settle(last: bool = False) -> None:
            """Finds the places of the bucket at hand; packs those found once they are many."""
            nonlocal n_found, found
            if held:
                found.append(duplicates(held))
                n_found += len(found[-1][0])
            if found and (last or n_found > 100_000):
                ready.extend((p, 0, None, None, blob) for p, blob in _places(*(np.concatenate(x) for x in zip(*found, strict=True)), parts))
                found, n_found = [], 0

        for batch in batches:
            for bucket, kind, _, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    ready.append((part, 0, None, None, blob))
                    continue
                if bucket != at:
                    settle()
                    at, held = bucket, []
                held.append(blob)
                if len(ready) >= 500:
                    yield _batch(ready)
                    ready = []
        settle(last=True)
        if ready:
            yield _batch(ready)
        trim()

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches, 1, FLUSH):
            ids, texts = _texts(flush)
            keys = _keys(ids, texts, repeated)
            part = _part(keys, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = []
            for k, a in enumerate(cuts):
                b = cuts[k + 1] if k + 1 < len(cuts) else len(order)
                own = order[a:b]
                rows.append((int(part[own[0]]), 1, None, None, _press(ids[own], keys[own] if repeated else b"", b"\n".join(texts[j] for j in own))))
            if rows:
                yield _batch(rows)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, places before documents."""
        at, found, ready = None, [], None
        for batch in batches:
            for part, kind, _, _, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, found, ready = part, [], None
                if kind == 0:
                    ids, first, end = _loosen(blob)
                    found.append((np.frombuffer(ids, np.int64), np.frombuffer(first, np.int32), np.frombuffer(end, np.int32)))
                    continue
                if ready is None:
                    ids = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.int64)
                    ranges = np.column_stack([np.concatenate([x[k] for x in found]) for k in (1, 2)]) if found else np.empty((0, 2), np.int32)
                    order = np.argsort(ids, kind="stable")
                    ready = ids[order], ranges[order]
                ids, keys, texts = _loosen(blob)
                keys, ids = np.frombuffer(keys or ids, np.int64), np.frombuffer(ids, np.int64)
                lo, hi = np.searchsorted(ready[0], keys, "left").tolist(), np.searchsorted(ready[0], keys, "right").tolist()
                out = [keep(t, ready[1][a:b]) for t, a, b in zip(texts.split(b"\n"), lo, hi, strict=True)]
                columns = [
                    pa.array(ids, pa.int64(), mask=ids == NULL_ID),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()),
                ]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array([x[2].decode() for x in out], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)
        trim()

    packed = narrow.mapInArrow(split, PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    places = packed.mapInArrow(match, PACKED)
    both = places.unionAll(narrow.mapInArrow(carry, PACKED)).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(finish, SCHEMA + ", kept_text string" * keep_text)

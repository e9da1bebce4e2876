"""Near-duplicate components by an LSH forest over MinHash signatures.

1. Every document becomes its set of five-word shingles, hashed to 64 bits, a
   128-bit fingerprint of the set and a signature of TREES * DEPTH MinHash
   values. Documents of equal sets form a class; the row of its smallest doc_id stands for it.
2. Each tree orders the representatives by its own DEPTH values. Neighbours
   with a common prefix of START values or more form a region; a region that
   holds too many is cut into parts, by the next values and at full depth by chunks.
3. In a region, or in a part of one, the unmatched class nearest its centre becomes a hub, and pairs of a hub and
   a member whose signatures agree in FLOOR of all values are candidates:
   a line per member and hub, never all pairs. Candidates are confirmed on full sets.
4. Where confirmed links leave a region's members in different components, the
   remaining similar pairs across components are compared too, those of different parts
   included, in blocks of two chunks where the region is large; each in the first tree that
   brings it together. A shingle that no other such member has can be in no intersection, which
   bounds the similarity of any pair from above and rules most of them out exactly; the rest
   meet with their full sets where the region is, and only links leave it. So a link is lost only if no
   tree brings its documents together (2e-6 at similarity 0.75) or the signatures mislead (2e-5).

Components come from alternating large-star and small-star steps on tables;
nothing is collected.

Edge cases: null and blank texts have empty sets, link with nothing and are
kept; fewer than five words make one shingle, the whole sequence; a null doc_id
links with nothing, its component_id is null and kept is true; the texts of one doc_id are
in one component, which has the links of them all; a blank row among them is a component of its own, named by its id; an empty table gives no rows; extra columns, of any name, are ignored by components() and kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small, staged, without_ids
from .textbytes import Words, flushes, grams, mixed

SHINGLE = 5
#: Link where 100 * intersection >= SIMILAR * union.
SIMILAR = 75
TREES, DEPTH, START = 16, 4, 2
VALUES = TREES * DEPTH
#: Agreeing values of a candidate pair: 4.6 standard deviations below the threshold.
FLOOR = VALUES // 2
#: Members above which a region is split by its next value, in a worker and before the shuffle, and of a chunk.
REGION, HOT = 8192, 20_000
FLUSH = 6 << 20

SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"

_rng = np.random.default_rng(20_240_517)
FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; A-Z are lower-cased, other letters are not."""
    plain = [b" ".join(t.lower().split()) for t in texts]
    w = Words(b"\n".join(plain) + b"\n")
    ends = np.searchsorted(w.start, np.cumsum(np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain))), "left").tolist()
    every = grams(w.hash, SHINGLE)
    out, a = [], 0
    for b in ends:
        out.append(np.unique(every[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(w.hash[a:b], b - a) if b > a else every[:0])
        a = b
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of VALUES 32-bit minima for each non-empty set."""
    out = np.empty((len(sets), VALUES), np.uint32)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(sets):
            last, size = first, 0
            while last < len(sets) and (size < 1 << 15 or last == first):
                size += len(sets[last])
                last += 1
            x = np.concatenate(sets[first:last])
            at = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
            for k in range(VALUES):
                out[first:last, k] = np.minimum.reduceat(x * FACTORS[k] + TERMS[k], at) >> np.uint64(32)
            first = last
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(s).sum(dtype=np.uint64).astype(np.int64)), int(mixed(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).astype(np.int64))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, set size, fingerprint and signature of every document; the signature of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches, 1, FLUSH):
            sets = shingle_sets([t.as_py() or b"" for t in flush.column(1).cast(pa.binary())])
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full))
            marks = [_fingerprint(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    flush.column(0).combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "fp1", "fp2", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def _column(values, kind) -> pa.Array:
    return pa.array(values, kind)


def _region_rows(reps: DataFrame, start: int = START) -> DataFrame:
    """A row for each tree of each representative: its region's key, the keys of the deeper regions, and 8 bits of every value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, VALUES)
            brief = sig.astype(np.uint8)
            brief = [r.tobytes() for r in brief]
            for t in range(TREES):
                key = np.full(n, t + 1, np.uint64)
                keys = []
                with np.errstate(over="ignore"):
                    for d in range(DEPTH):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, t * DEPTH + d])
                        if d + 1 >= start:
                            keys.append(pa.array(key.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*keys, batch.column(0), batch.column(1), _column(brief, pa.binary()), _column([t] * n, pa.int32())], [*names, "rep", "n", "brief", "tree"])

    names = [f"k{d}" for d in range(start, DEPTH + 1)]
    schema = ", ".join(f"{k} long" for k in names) + ", rep long, n long, brief binary, tree int"
    return reps.select("rep", "n", "sig").mapInArrow(run, schema)


def _deepened(rows: DataFrame) -> DataFrame:
    """Rows with `region`, `key`, the deepest key whose part would else be hot, and `cut`, whether the region has parts."""
    rows = rows.withColumn("region", F.col(f"k{START}")).withColumn("key", F.col("region"))
    for d in range(START + 1, DEPTH + 2):
        hot = staged(rows.groupBy("key").agg(F.count("*").alias("__m")).filter(F.col("__m") > HOT), "hot-regions")
        n = hot.count()
        if not n:
            break
        marked = rows.join(small(hot.withColumnRenamed("key", "__hot"), n, 40), F.col("key") == F.col("__hot"), "left")
        chunk = F.xxhash64("key", F.pmod(F.xxhash64("rep", "tree"), F.ceil(F.col("__m") / HOT)))
        deeper = F.col(f"k{d}") if d <= DEPTH else chunk
        rows = marked.withColumn("key", F.when(F.col("__hot").isNotNull(), deeper).otherwise(F.col("key"))).drop("__hot", "__m")
    return rows.withColumn("cut", F.col("key") != F.col("region"))


def _split_region(brief: np.ndarray, tree: int, at: np.ndarray, depth: int = START) -> Iterator[np.ndarray]:
    """Places of a region, by the tree's next values while it holds more than REGION."""
    if len(at) <= REGION or depth >= DEPTH:
        yield at
        return
    value = brief[at, tree * DEPTH + depth]
    order = np.argsort(value, kind="stable")
    for part in np.split(at[order], np.flatnonzero(np.diff(value[order])) + 1):
        yield from _split_region(brief, tree, part, depth + 1)


def _alike(brief: np.ndarray, n: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    """Those of others whose signature and set size allow a link with k."""
    fits = others[(100 * np.minimum(n[others], n[k]) >= SIMILAR * np.maximum(n[others], n[k]))]
    return fits[(brief[fits] == brief[k]).sum(1) >= FLOOR] if len(fits) else fits


def _central(brief: np.ndarray) -> np.ndarray:
    """How many of each row's values are the most frequent ones of their places: near copies of one text agree most with that text."""
    common = [np.bincount(column, minlength=256).argmax() for column in brief.T]
    return (brief == np.asarray(common, np.uint8)).sum(1)


def _stars(rep: np.ndarray, n: np.ndarray, brief: np.ndarray) -> Iterator[tuple[int, int]]:
    """(hub, member): the most central unmatched class is the next hub and meets all others of the region.

    A hub at the centre of its near copies leaves few of them to be hubs. Centres are sought anew each time that half of
    those without a match are gone.
    """
    free = np.ones(len(rep), bool)
    while len(left := np.flatnonzero(free)):
        order = left[np.lexsort((rep[left], -_central(brief[left])))] if len(left) > 2 else left[np.argsort(rep[left])]
        enough = len(left) // 2
        for k in order:
            if not free[k]:
                continue
            free[k] = False
            others = np.flatnonzero(rep != rep[k])
            near = _alike(brief, n, k, others)
            free[near] = False
            for j in near:
                yield int(rep[k]), int(rep[j])
            if len(near) and np.count_nonzero(free) <= enough:
                break


def _by_key(batches: Iterator[pa.RecordBatch], cut: int | None = None) -> Iterator[tuple[int, list[tuple]]]:
    """Groups of two rows or more that come sorted by their first column; of one row too where its column `cut` is true."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at:
                if len(held) > 1 or (held and cut is not None and held[0][cut]):
                    yield at, held
                at, held = row[0], []
            held.append(row)
    if len(held) > 1 or (held and cut is not None and held[0][cut]):
        yield at, held


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), VALUES)


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)


def _candidates(rows: DataFrame, parts: int) -> DataFrame:
    """(region, part, a, b, tree): a hub and a member of its part that look alike; a = b for an unmatched row of a region in parts."""

    def pairs(batches):
        for key, held in _by_key(batches, 6):
            rep, n, brief = _arrays(held)
            tree, region, cut = held[0][4:7]
            split = list(_split_region(brief, tree, np.arange(len(rep))))
            for i, at in enumerate(split):
                met, part = set(), key ^ i
                for a, b in _stars(rep[at], n[at], brief[at]):
                    met.update((a, b))
                    yield region, part, a, b, tree
                if cut or len(split) > 1:
                    for a in set(rep[at].tolist()) - met:
                        yield region, part, a, a, tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(pairs(batches), ["region", "part", "a", "b", "tree"])

    dealt = rows.select("key", "rep", "n", "brief", "tree", "region", "cut").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "region long, part long, a long, b long, tree long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with `key`, a block of at most two chunks of their region, and their `chunk`; every two chunks of a region meet in a block."""
    large = staged(members.groupBy("region").agg(F.count("*").alias("__m")).filter(F.col("__m") > HOT), "large-regions")
    sized = members.join(small(large.withColumnRenamed("region", "__large"), large.count(), 40), F.col("region") == F.col("__large"), "left")
    sized = sized.withColumn("__c", F.coalesce(F.ceil(F.col("__m") / HOT).cast("int"), F.lit(1)))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("__c")).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    block = F.xxhash64("region", F.least("chunk", "__o"), F.greatest("chunk", "__o"))
    return sized.withColumn("key", F.when(F.col("__c") > 1, block).otherwise(F.col("region")))


def _remaining(members: DataFrame, parts: int) -> DataFrame:
    """(a, b): links of a region across components that join all which links of its pairs join: of pairs that look alike, may share enough and were no hub's pair."""

    def links(batches):
        for _, held in _by_key(batches):
            rep, n, brief = _arrays(held)
            comp, hub, shared = np.array([r[4] for r in held], np.int64), np.array([bool(r[5]) for r in held]), np.array([r[6] for r in held], np.int64)
            tree = held[0][7]
            part, chunk = np.array([r[9] for r in held], np.int64), np.array([r[10] for r in held], np.int64)
            # a block of two chunks holds the rows of both, and compares one's with the other's only
            across = len(set(chunk.tolist())) > 1
            before = np.frombuffer(b"".join(r[11] for r in held), np.uint32).reshape(len(rep), TREES, START)[:, :tree]
            for k in range(len(rep)) if (part != part[0]).any() else np.flatnonzero(~hub):
                met = (part == part[k]) & (hub | hub[k])
                others = np.flatnonzero(~met & (rep > rep[k]) & (comp != comp[k]) & ((chunk != chunk[k]) | (not across)))
                most = np.minimum(shared[others], shared[k])
                others = others[100 * most >= SIMILAR * (n[others] + n[k] - most)]
                # an earlier tree that has both in one region has compared the pair
                others = others[~(before[others] == before[k]).all(2).any(1)]
                for j in _alike(brief, n, k, others):
                    if comp[j] != comp[k] and _linked(held[k][8], held[j][8]):
                        comp[comp == comp[j]] = comp[k]
                        yield int(rep[k]), int(rep[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(links(batches), ["a", "b"])

    dealt = _blocks(members).select("key", "rep", "n", "brief", "comp", "hub", "shared", "tree", "s", "part", "chunk", "first").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def _linked(a: bytes, b: bytes) -> bool:
    """Whether two sets, sorted hashes as bytes, are similar enough."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= SIMILAR * (len(x) + len(y) - both)


def _shared(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shared): of each id's shingles, those that another of the ids has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
            ids = np.repeat(np.asarray(batch.column(0)), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(each) if each else [], pa.int64())], ["id", "h"])

    each = sets.join(ids, "id", "left_semi").select("id", "s").mapInArrow(run, "id long, h long")
    common = each.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    return each.join(common, "h").groupBy("id").agg(F.count("*").alias("shared")).withColumnRenamed("id", "rep")


def _sets_of(docs: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, s): the full shingle set of every node, as the bytes of its sorted hashes; nodes (id, doc_id, fp1, fp2).

    A node is found again by its doc_id and the fingerprint of its set. `repeated` names the nodes whose row
    stands in docs more than once.
    """
    ids = nodes.select(F.col("doc_id").alias("__id")).distinct()
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(ids, nodes.count(), 24), F.col("doc_id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flush in flushes(batches, 1, FLUSH):
            sets = shingle_sets([t.as_py() or b"" for t in flush.column(1).cast(pa.binary())])
            marks = [_fingerprint(s) if len(s) else (None, None) for s in sets]
            columns = [flush.column(0).combine_chunks(), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp1", "fp2", "s"])

    found = held.mapInArrow(run, "doc_id long, fp1 long, fp2 long, s binary").join(nodes, ["doc_id", "fp1", "fp2"]).select("id", "s")
    if not repeated.isEmpty():
        found = staged(found, "repeated-sets")
        again = found.join(repeated, "id", "left_semi").groupBy("id").agg(F.first("s").alias("s"))
        found = found.join(repeated, "id", "left_anti").unionByName(again)
    return found


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of a link: comp is the smallest node reachable. Alternating large-star and small-star."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # u > v in every edge: v's own link to the minimum, and u's.
        nudged = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = staged(nudged.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots)


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and class_id, the smallest doc_id of the same set.

    The nodes of all steps are classes of equal sets, known by the row of their smallest doc_id, so that a
    doc_id of several texts is as many nodes, which are linked through it.
    """
    parts = shuffle_width(docs.sparkSession)
    every = staged(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    usable = every.filter(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep_doc"), F.min_by("row", "doc_id").alias("node"), F.count("*").alias("m"))
    classes = staged(classes, "classes")
    reps = usable.join(classes.select("node"), F.col("row") == F.col("node")).select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), "sig")
    reps = staged(reps, "representatives")
    rows = _deepened(_region_rows(reps))
    stars = staged(_candidates(rows, parts), "stars")

    # Ids of several rows: those of one text repeat a node's row, those of several texts link their classes.
    several = staged(usable.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("doc_id"), "repeated-ids")
    many = staged(usable.join(small(several, several.count(), 24), "doc_id", "left_semi").select("doc_id", "fp1", "fp2").distinct().join(classes.select("fp1", "fp2", "node", "rep_doc"), ["fp1", "fp2"]), "ids-of-classes")
    repeated = many.filter("doc_id = rep_doc").select(F.col("node").alias("id")).distinct()
    hubs = many.groupBy("doc_id").agg(F.min("node").alias("a"))
    own = many.join(hubs, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = staged(pairs, "pairs")
    ids = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = staged(ids.join(classes.select(F.col("node").alias("id"), F.col("rep_doc").alias("doc_id"), "fp1", "fp2"), "id"), "pair-nodes")
    sets = staged(_sets_of(docs, nodes, repeated), "pair-sets")
    links = staged(confirmed(pairs, sets).unionByName(own), "confirmed")
    comp = staged(connected(links), "components")

    # Regions whose members' components still differ.
    named = lambda c: comp.select(F.col("node").alias(f"__{c}"), F.col("comp").alias(f"__comp_{c}"))
    known = (
        stars.join(named("a"), F.col("a") == F.col("__a"), "left").join(named("b"), F.col("b") == F.col("__b"), "left")
        .select("region", "part", "tree", "a", "b", F.coalesce("__comp_a", "a").alias("ca"), F.coalesce("__comp_b", "b").alias("cb"))
    )
    known = staged(known, "known")
    differing = known.groupBy("region").agg(F.min(F.least("ca", "cb")).alias("lo"), F.max(F.greatest("ca", "cb")).alias("hi"), F.count("*").alias("m")).filter("lo <> hi and m > 1").select("region")
    open_regions = staged(differing, "open-regions")
    members = (
        known.join(small(open_regions, open_regions.count(), 16), "region").select("region", "part", "tree", F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("ca").alias("comp"), F.lit(1).alias("hub")), F.struct(F.col("b").alias("rep"), F.col("cb").alias("comp"), F.lit(0).alias("hub")))).alias("x"))
        .groupBy("region", "part", "tree", "x.rep", "x.comp").agg(F.max("x.hub").alias("hub"))
    )
    members = staged(members, "open-members")
    shared = staged(_shared(sets, members.select(F.col("rep").alias("id")).distinct()), "shared")
    # Members that hold too few shared shingles can link with nothing that is left.
    held = members.join(shared, "rep").join(_briefs(reps), "rep").filter(100 * F.col("shared") >= SIMILAR * F.col("n")).join(sets.withColumnRenamed("id", "rep"), "rep")
    second = staged(_remaining(held, parts).distinct(), "confirmed-2")
    merged = second.join(named("a"), F.col("a") == F.col("__a"), "left").join(named("b"), F.col("b") == F.col("__b"), "left").select(F.coalesce("__comp_a", "a").alias("a"), F.coalesce("__comp_b", "b").alias("b"))
    joined = staged(connected(merged), "components-2")

    # A component is named by its smallest doc_id; classes that stand alone are not joined to anything.
    later = joined.select(F.col("node").alias("__was"), F.col("comp").alias("__top"))
    tops = (
        comp.join(later, F.col("comp") == F.col("__was"), "left").select("node", F.coalesce("__top", "comp").alias("top"))
        .unionByName(joined.join(comp, "node", "left_anti").select("node", F.col("comp").alias("top")))
    )
    linked = staged(classes.join(tops, "node").select("fp1", "fp2", "rep_doc", "top"), "linked-classes")
    least = linked.groupBy("top").agg(F.min("rep_doc").alias("__comp"))
    whole = (
        linked.join(least, "top").select("fp1", "fp2", "rep_doc", "__comp")
        .unionByName(classes.filter("m > 1").join(linked.select("fp1", "fp2"), ["fp1", "fp2"], "left_anti").select("fp1", "fp2", "rep_doc", F.col("rep_doc").alias("__comp")))
        .select(F.col("fp1").alias("__f1"), F.col("fp2").alias("__f2"), F.col("rep_doc").alias("class_id"), "__comp")
    )
    whole = staged(whole, "class-components")
    found = every.drop("sig").join(whole, (F.col("fp1") == F.col("__f1")) & (F.col("fp2") == F.col("__f2")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("__comp", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def _briefs(reps: DataFrame) -> DataFrame:
    """(rep, n, brief, first): 8 bits of every value, and the values in full of which each tree's regions are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.frombuffer(s, np.uint32) for s in batch.column(2).to_pylist()]
            brief, first = [s.astype(np.uint8).tobytes() for s in sigs], [s.reshape(TREES, DEPTH)[:, :START].tobytes() for s in sigs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(brief, pa.binary()), pa.array(first, pa.binary())], ["rep", "n", "brief", "first"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, brief binary, first binary")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; of rows that repeat it, all stay."""
    gone = staged(components(docs).filter(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return without_ids(docs, gone)

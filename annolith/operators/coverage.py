"""Coverage, reconciliation and enrichment joins. Joins are written plainly: Spark picks broadcast or sort-merge by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import rules


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def coverage(data: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """(state, key): `unassigned` rows of data in no split, `stale` ones of splits not in data."""
    a = without(data.select(key).distinct(), splits, key).select(F.lit("unassigned").alias("state"), key)
    return a.unionByName(without(splits.select(key).distinct(), data, key).select(F.lit("stale").alias("state"), key))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def split_audit(synthetic: DataFrame, real: DataFrame, meta: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(check, n): everything that would make a split's numbers a lie; 0 throughout if it is clean.

    synthetic (image, split), real (image, group, split), meta (image, plate_num), hashes (image, sha256).
    """
    from .splits import spanning

    both = synthetic.select("image", F.concat(F.lit("synthetic:"), "split").alias("split"))
    last = real.select("image", F.concat(F.lit("real:"), "split").alias("split"))
    combined = last.unionByName(both.join(last, "image", "left_anti"))
    images = meta.select("image").distinct()
    placed = combined.join(meta.select("image", X.stripped(F.col("plate_num")).alias("plate")), "image").filter("plate <> ''")
    checks = {
        "in_both": overlap(synthetic, real, "image"),
        "unassigned": without(images, combined, "image"),
        "stale": without(combined.select("image"), images, "image"),
        "plate_spans": spanning(placed, "plate"),
        "group_spans": spanning(real, "group"),
    }
    if hashes is not None:
        checks["hash_spans"] = spanning(combined.join(hashes, "image"), "sha256")
    out = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def pair_by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, image, label): images of a unique stem with the last label of that stem, or NULL."""
    stem = lambda c: F.regexp_replace(X.path_name(F.col(c)), r"\.[^.]*$", "")
    one = images.groupBy(stem("path").alias("stem")).agg(F.min("path").alias("image"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return one.join(labels.groupBy(stem("path").alias("stem")).agg(F.max("path").alias("label")), "stem", "left")


def pairing_findings(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(state, stem): images without label, labels without image, stems of several images."""
    stem = lambda d: d.select(F.regexp_replace(X.path_name(F.col("path")), r"\.[^.]*$", "").alias("stem"))
    a, b = stem(images), stem(labels)
    told = lambda d, s: d.select(F.lit(s).alias("state"), "stem")
    several = a.groupBy("stem").count().filter("count > 1")
    return told(without(a, b, "stem").distinct(), "image_without_label").unionByName(told(without(b, a, "stem").distinct(), "label_without_image")).unionByName(told(several, "ambiguous"))


def annotation_state(images: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: counts of rows, annotated images, images without rows and rows' images that are not there."""
    a, b = images.select("image").distinct(), meta.select("image").distinct()
    return (
        meta.agg(F.count("*").alias("rows")).join(overlap(a, b, "image").agg(F.count("*").alias("annotated")))
        .join(without(a, b, "image").agg(F.count("*").alias("without_rows"))).join(without(b, a, "image").agg(F.count("*").alias("without_image")))
    )


def privacy_findings(images: DataFrame, review: DataFrame) -> DataFrame:
    """(image, finding): not reviewed, unknown action, faces left open, or rejected. review (image, faces_present, action, reviewer)."""
    from ..vocab import PRIVACY_ACTIONS

    action, faces = F.lower(X.stripped(F.col("action"))), X.parse_bool(F.col("faces_present"))
    found = review.select("image", F.explode(rules.problems([
        (~action.isin(*PRIVACY_ACTIONS), F.concat(F.lit("action '"), action, F.lit("' is unknown"))),
        (F.coalesce(faces, F.lit(False)) & (action == "none_needed"), F.lit("faces are present but no action was taken")),
        (X.stripped(F.col("reviewer")) == "", F.lit("no reviewer is named")),
        (action == "rejected", F.lit("rejected")),
    ])).alias("finding"))
    return found.unionByName(without(images.select("image"), review, "image").select("image", F.lit("not reviewed").alias("finding")))


def already_known(staged: DataFrame, dataset: DataFrame) -> DataFrame:
    """Staged images whose bytes the dataset has: (image, known_as), both with sha256."""
    return staged.join(dataset.groupBy("sha256").agg(F.max("image").alias("known_as")), "sha256").select("image", "known_as")


def promotable(images: DataFrame, *gates: DataFrame) -> DataFrame:
    """Images that every gate lists."""
    for gate in gates:
        images = images.join(gate.select("image"), "image", "left_semi")
    return images


def clash_free_union(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """UNION ALL with `clash` true on added rows whose key exists already."""
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    marked = added.join(known, key, "left").withColumn("clash", F.coalesce("__known", F.lit(False))).drop("__known")
    return existing.withColumn("clash", F.lit(False)).unionByName(marked)


def merge_candidates(shape: DataFrame, colour: DataFrame) -> DataFrame:
    """(path, reasons, colour): full outer merge, reasons in order of the two sides, the second's colour over the first's."""
    b = colour.select("path", F.col("reasons").alias("__r"), F.col("colour").alias("__c"))
    empty = F.array().cast("array<string>")
    merged = shape.join(b, "path", "full_outer")
    return merged.select("path", F.array_union(F.coalesce("reasons", empty), F.coalesce("__r", empty)).alias("reasons"), F.coalesce("__c", "colour").alias("colour"))


def enrich(base: DataFrame, *tables: DataFrame, key: str = "image") -> DataFrame:
    """base with the columns of each table by key, NULL where it has no row."""
    for t in tables:
        base = base.join(t, key, "left")
    return base


def live_status(approved: DataFrame, live: DataFrame) -> DataFrame:
    """Approved rows with their live struct by title and the reasons to hold them back."""
    titled = approved.withColumn("title", X.url_title(F.col("file_page_url")))
    struct = F.struct(*(F.col(c) for c in live.columns if c != "title")).alias("live")
    joined = titled.join(live.select("title", struct), "title", "left").withColumn("problems", rules.source_problems(F.col("license"), F.col("live")))
    return joined.withColumn("status", F.when(F.size("problems") == 0, "VERIFIED").otherwise("HELD"))


def reconcile_classes(used: DataFrame, declared: DataFrame) -> DataFrame:
    """(state, class_id): undeclared ids in use and declared ids not in use."""
    a, b = used.select("class_id").distinct(), declared.select("class_id").distinct()
    told = lambda d, s: d.select(F.lit(s).alias("state"), "class_id")
    return told(without(a, b, "class_id"), "undeclared").unionByName(told(without(b, a, "class_id"), "unused"))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """(node, depth): breadth first from roots over (parent, child), each node at its first depth; at most `most` levels."""
    found = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front = found
    for depth in range(1, most + 1):
        front = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct().join(found, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found

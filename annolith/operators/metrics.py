"""Evaluation metrics as column arithmetic over plain aggregates. Undefined rates are NULL; populations are group keys and never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..vocab import IOU_LADDER, WILSON_Z
from . import matching as M
from .splits import ranges


def wilson(successes: Column, total: Column, z: float = WILSON_Z) -> Column:
    """struct(low, high) of the Wilson score interval, clamped; (0, 1) where there is nothing to count."""
    n, p = total.cast("double"), F.try_divide(successes, total)
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    some = total > 0
    low = F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(F.lit(0.0))
    high = F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), high.alias("high"))


def proportion(successes: Column, total: Column) -> Column:
    ci = wilson(successes, total)
    return F.struct(
        F.try_divide(successes, total).alias("value"), successes.alias("successes"), total.alias("total"), F.bround(ci["low"], 4).alias("low"), F.bround(ci["high"], 4).alias("high")
    )


def rates(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(precision, recall, f1); f1 is NULL where either rate is 0 or NULL."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).alias("f1"))


def average_precision(scored: DataFrame, n_truth: Column, keys: list[str], score: str, is_tp: str, tie: list[str], costly: bool = False) -> DataFrame:
    """(keys, ap): all-points interpolated average precision of each group's ranked list; n_truth is an aggregate over the group.

    Recall steps only where a true positive stands, and the envelope there is the best
    precision from it on. A list is cut into ranges of its order; running counts
    and envelopes are taken within a range and carried over from the small table of
    ranges, so a long list is shared by as many tasks as there are ranges. costly: see ranges().
    """
    cut = ranges(scored.withColumn("__hit", F.col(is_tp).cast("int")), [*(F.col(k) for k in keys), F.col(score).desc(), *(F.col(t) for t in tie)], "ranked", costly)
    by = [*keys, "__part"]
    totals = cut.groupBy(*by).agg(F.sum("__hit").alias("__h"), F.count("*").alias("__c"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*by, F.coalesce(F.sum("__h").over(before), F.lit(0)).alias("__h0"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"))
    upto = W.partitionBy(*by).orderBy(F.col(score).desc(), *tie).rowsBetween(W.unboundedPreceding, 0)
    running = cut.withColumns({"__tp": F.sum("__hit").over(upto), "__rank": F.count("*").over(upto)}).join(carried, by)
    precision = (F.col("__h0") + F.col("__tp")) / (F.col("__c0") + F.col("__rank"))
    running = running.withColumn("__precision", precision)
    later = W.partitionBy(*keys).orderBy(F.col("__part").desc()).rowsBetween(W.unboundedPreceding, -1)
    peaks = running.groupBy(*by).agg(F.max("__precision").alias("__peak")).select(*by, F.max("__peak").over(later).alias("__later"))
    # from the end of the range backwards: a frame that grows, where one that shrinks would be computed anew for every row
    onward = W.partitionBy(*by).orderBy(F.col(score).asc(), *(F.col(t).desc() for t in tie)).rowsBetween(W.unboundedPreceding, 0)
    best = running.withColumn("__onward", F.max("__precision").over(onward)).join(peaks, by)
    best = best.withColumn("__best", F.greatest("__onward", F.coalesce("__later", F.lit(0.0))))
    n = cut.groupBy(*keys).agg(n_truth.alias("__n"))
    areas = best.groupBy(*keys).agg(F.sum(F.when(F.col("__hit") == 1, F.col("__best"))).alias("__area"))
    return areas.join(n, keys).select(*keys, F.when(F.col("__n") > 0, F.coalesce(F.col("__area"), F.lit(0.0)) / F.col("__n")).otherwise(F.lit(0.0)).alias("ap"))


def confusion(pairs: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """(truth, predicted, n) of every pair of classes, 0 included; unknown labels are dropped."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"truth {pairs.schema[truth].dataType.simpleString()}, predicted {pairs.schema[predicted].dataType.simpleString()}")
    counts = pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) from a confusion matrix."""
    side = F.array(F.struct(F.col("truth").alias("class"), F.lit(True).alias("own")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("own")))
    hit = F.col("truth") == F.col("predicted")
    flat = matrix.select("n", hit.alias("hit"), F.explode(side).alias("x")).select("n", "hit", "x.*")
    sums = flat.groupBy("class").agg(
        F.sum(F.when(F.col("hit") & F.col("own"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & ~F.col("own"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & F.col("own"), F.col("n")).otherwise(0)).alias("fn"),
    )
    scored = sums.withColumn("r", rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return scored.select("class", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), "r.precision", "r.recall", "r.f1")


def macro(scores: DataFrame) -> DataFrame:
    """One row of macro averages: NULL rates count 0, classes absent from truth and predictions are left out."""
    counted = scores.filter((F.col("support") > 0) | (F.col("tp") + F.col("fp") > 0))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0))).alias(c)
    return counted.agg(mean("precision"), mean("recall"), mean("f1"), F.array_sort(F.collect_list("class")).alias("classes"))


def ocr_scores(pairs: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Exact matches, edits and character error rate, by keys."""
    t, p = F.col(truth), F.col(predicted)
    sums = pairs.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), F.coalesce(F.sum((t == p).cast("long")), F.lit(0)).alias("exact"),
        F.coalesce(F.sum(F.levenshtein(t, p).cast("long")), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.length(t).cast("long")), F.lit(0)).alias("characters"),
    )
    return sums.withColumn("cer", F.try_divide("edits", "characters")).withColumn("exact_rate", F.try_divide("exact", "total"))


def failure_category(truth: Column, truth_type: Column, read: Column, read_type: Column, scored: Column) -> Column:
    """What went wrong with a reading; `scored` is whether the truth's text can be judged."""
    type_ok, text_ok = truth_type == read_type, truth == read
    kind = F.when(F.levenshtein(truth, read) == 1, "text_1_edit").when(F.length(truth) != F.length(read), "text_length").otherwise("text_multi_edit")
    return (
        F.when(~scored, F.when(type_ok, "type_ok_unscored_text").otherwise("type_wrong_unscored_text"))
        .when(text_ok & type_ok, "correct").when(text_ok, "type_wrong").when(type_ok, kind).otherwise(F.concat(kind, F.lit("+type_wrong")))
    )


def exploded_dimensions(df: DataFrame, dimensions: dict[str, Column], tags: Column | None = None) -> DataFrame:
    """df once for each (dimension, value) of a row, NULL values left out; tags count one by one under `condition`."""
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dimensions.items()))
    if tags is not None:
        pairs = F.concat(pairs, F.transform(tags, lambda t: F.struct(F.lit("condition").alias("dimension"), t.alias("value"))))
    return df.withColumn("__d", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull()))).withColumns({"dimension": F.col("__d.dimension"), "value": F.col("__d.value")}).drop("__d")


def reading_report(readings: DataFrame, dimensions: dict[str, Column], tags: Column | None = None) -> DataFrame:
    """By dimension and value: plates, type accuracy, judged plates, exact strings, edits and CER; `all` is a dimension.

    readings (plate_num, plate_type, raw_text, read_type, scored).
    """
    each = exploded_dimensions(readings, {"all": F.lit("all"), **dimensions}, tags)
    ok, s = F.col("plate_type") == F.col("read_type"), F.col("scored")
    exact = s & (F.col("plate_num") == F.col("raw_text"))
    n = lambda c: F.sum(c.cast("long"))
    out = each.groupBy("dimension", "value").agg(
        F.count("*").alias("plates"), n(ok).alias("type_correct"), n(s).alias("judged"), n(exact).alias("exact"), n(exact & ok).alias("both_correct"),
        F.sum(F.when(s, F.levenshtein("plate_num", "raw_text")).otherwise(0).cast("long")).alias("edits"), F.sum(F.when(s, F.length("plate_num")).otherwise(0).cast("long")).alias("characters"),
    )
    return out.withColumn("cer", F.try_divide("edits", "characters"))


def detection_report(truth: DataFrame, predictions: DataFrame | None, image: str = "image", ladder: tuple[float, ...] = IOU_LADDER) -> DataFrame:
    """(threshold, ap, n_truth) over a ladder of IoU thresholds; truth (image, truth), predictions (image, predictions), or none if truth has both.

    The list that average precision ranks is by score, then image, an image's matches first. It is ranked once, with a column of hits a
    threshold: of an image's predictions of one score, precision is highest at the last match, and all its matches have the envelope there.
    """
    steps = range(len(ladder))
    cut = ranges(M.ladder_rows(M.paired(truth, predictions, image), image, ladder), [F.col("score").desc(), F.col(image)], "ranked", costly=True)
    counted = ["n", *(f"hits_{k}" for k in steps)]
    rows = cut.filter("n > 0")
    totals = rows.groupBy("__part").agg(*(F.sum(c).alias(f"__{c}") for c in counted))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # a row for each range
    carried = totals.select("__part", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in counted))
    upto = W.partitionBy("__part").orderBy(F.col("score").desc(), image).rowsBetween(W.unboundedPreceding, 0)
    running = rows.withColumns({f"__up_{c}": F.sum(c).over(upto) for c in counted}).join(F.broadcast(carried), "__part")
    hits = lambda k: F.col(f"hits_{k}")
    precision = lambda k: (F.col(f"__hits_{k}") + F.col(f"__up_hits_{k}")) / (F.col("__n") + F.col("__up_n") - F.col("n") + hits(k))
    running = running.select("__part", "score", image, *counted[1:], *(F.when(hits(k) > 0, precision(k)).otherwise(F.lit(0.0)).alias(f"__p_{k}") for k in steps))
    later = W.orderBy(F.col("__part").desc()).rowsBetween(W.unboundedPreceding, -1)
    peaks = running.groupBy("__part").agg(*(F.max(f"__p_{k}").alias(f"__peak_{k}") for k in steps))
    peaks = peaks.select("__part", *(F.coalesce(F.max(f"__peak_{k}").over(later), F.lit(0.0)).alias(f"__later_{k}") for k in steps))
    onward = W.partitionBy("__part").orderBy(F.col("score").asc(), F.col(image).desc()).rowsBetween(W.unboundedPreceding, 0)
    best = running.withColumns({f"__on_{k}": F.max(f"__p_{k}").over(onward) for k in steps}).join(F.broadcast(peaks), "__part")
    areas = best.agg(F.count(F.lit(1)).alias("__rows"), *(F.sum(hits(k) * F.greatest(f"__on_{k}", f"__later_{k}")).alias(f"__area_{k}") for k in steps)).filter("__rows > 0")
    total = cut.agg(F.sum("truths").alias("n")).scalar()
    each = F.explode(F.array(*(F.struct(F.lit(th).alias("threshold"), F.col(f"__area_{k}").alias("area")) for k, th in enumerate(ladder))))
    ap = F.when(F.col("n_truth") > 0, F.col("e.area") / F.col("n_truth")).otherwise(F.lit(0.0))
    return areas.select(each.alias("e")).withColumn("n_truth", total).select("e.threshold", ap.alias("ap"), "n_truth")


def _matched_above(truth: DataFrame, predictions: DataFrame | None, image: str, confidence: float, threshold: float) -> DataFrame:
    images = M.paired(truth, predictions, image)
    return M.matched_images(images.withColumn("predictions", F.filter("predictions", lambda p: p["score"] >= confidence)), None, image, threshold)


def operating_point(truth: DataFrame, predictions: DataFrame | None, confidence: float, threshold: float = 0.5, image: str = "image") -> DataFrame:
    """One row of TP, FP, FN and rates at an operating confidence, and the images with a false positive."""
    m = _matched_above(truth, predictions, image, confidence, threshold)
    tp, fp, fn = F.size("matches"), F.size("predictions") - F.size("matches"), F.size("truth") - F.size("matches")
    sums = m.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.sum((fp > 0).cast("long")).alias("images_with_fp"))
    return sums.withColumn("r", rates(F.col("tp"), F.col("fp"), F.col("fn"))).select("tp", "fp", "fn", "images_with_fp", "r.precision", "r.recall", "r.f1")


def end_to_end(truth: DataFrame, predictions: DataFrame | None, confidence: float = 0.0, threshold: float = 0.5, image: str = "image") -> DataFrame:
    """(outcome, n) of every truth and every false detection: a plate that no detection meets is a failure, not an absence.

    truth (image, truth array of ordinal, box, plate_num, plate_type), predictions (image, predictions array of ordinal, score, box,
    plate_num, plate_type); detections below the confidence count for nothing.
    """
    m = _matched_above(truth, predictions, image, confidence, threshold)
    at = lambda rows, ordinal: F.get(F.filter(rows, lambda r: r["ordinal"] == ordinal), F.lit(0))

    def outcome(pair: Column) -> Column:
        t, p = at(F.col("truth"), pair["t"]), at(F.col("predictions"), pair["p"])
        type_ok, text_ok = t["plate_type"] == F.coalesce(p["plate_type"], F.lit("other")), t["plate_num"] == X.stripped(p["plate_num"])
        unread = F.when(type_ok, "unreadable_label").otherwise("unreadable_label+type_wrong")
        wrong = F.concat_ws("+", F.when(~text_ok, F.lit("string_wrong")), F.when(~type_ok, F.lit("type_wrong")))
        return F.when(type_ok & text_ok, "correct").when(~X.trainable(t["plate_num"], t["plate_type"]), unread).otherwise(wrong)

    missed, extra = F.size("truth") - F.size("matches"), F.size("predictions") - F.size("matches")
    counted = F.concat(
        F.transform("matches", lambda pair: F.struct(outcome(pair).alias("outcome"), F.lit(1).alias("n"))),
        F.array(F.struct(F.lit("not_detected").alias("outcome"), missed.alias("n")), F.struct(F.lit("false_positive_detection").alias("outcome"), extra.alias("n"))),
    )
    return m.select(F.explode(counted).alias("c")).groupBy("c.outcome").agg(F.sum("c.n").alias("n")).filter("n > 0")


def end_to_end_rate(outcomes: DataFrame) -> DataFrame:
    """One row: correct plates of all plates, with the interval; false detections are no plates."""
    plates = outcomes.filter("outcome <> 'false_positive_detection'")
    sums = plates.agg(F.coalesce(F.sum(F.when(F.col("outcome") == "correct", F.col("n"))), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sums.select(proportion(F.col("s"), F.col("n")).alias("p")).select("p.*")


def recall_by(truth_rows: DataFrame, dimensions: dict[str, Column], tags: Column | None = None) -> DataFrame:
    """(dimension, value, found, total, recall and its interval); truth_rows has a boolean `found`."""
    each = exploded_dimensions(truth_rows, {"all": F.lit("all"), "width": G.width_bin(F.col("width")), **dimensions}, tags)
    sums = each.groupBy("dimension", "value").agg(F.sum(F.col("found").cast("long")).alias("found"), F.count("*").alias("total"))
    return sums.withColumn("p", proportion(F.col("found"), F.col("total"))).select("dimension", "value", "found", "total", F.col("p.value").alias("recall"), "p.low", "p.high")


def confidence(detection: Column, kind: Column, read: Column, valid: Column, penalty: float = 0.5) -> Column:
    """Product of the stages' confidences, halved for an invalid format, clamped to [0, 1]."""
    raw = detection * kind * read * F.when(valid, 1.0).otherwise(penalty)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def best_epoch(log: DataFrame, keys: list[str], primary: str, secondary: str, epoch: str) -> DataFrame:
    """(keys, epoch) of the highest primary, then the lowest secondary, then the earliest."""
    rank = F.struct(F.coalesce(primary, F.lit(0.0)), -F.coalesce(secondary, F.lit(1.0)), -F.col(epoch))
    return log.groupBy(*keys).agg(F.max_by(epoch, rank).alias("best_epoch"))


def improvements(log: DataFrame, value: str, epoch: str, keys: list[str]) -> DataFrame:
    """log with `best_so_far`, `improved` and `stale`, the epochs since the last improvement."""
    by = W.partitionBy(*keys).orderBy(epoch)
    before = F.max(value).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = log.withColumn("improved", before.isNull() | (F.col(value) > before)).withColumn("best_so_far", F.max(value).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.withColumn("stale", F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(by.rowsBetween(W.unboundedPreceding, 0)))


def parity(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the largest difference of two backends' values, and the share of keys that agree to 1e-4."""
    d = F.abs(F.col("__a") - F.col("__b"))
    joined = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key)
    return joined.agg(F.max(d).alias("max_difference"), F.avg((d <= 1e-4).cast("double")).alias("match_rate"), F.count("*").alias("n"))


def learning_rate(epoch: Column, base: float, warm: int, total: int) -> Column:
    """Linear warm-up, then a cosine to 0."""
    rising = F.lit(base) * (epoch + 1) / F.lit(float(max(1, warm)))
    falling = F.lit(base / 2) * (1 + F.cos(F.pi() * (epoch - warm) / F.lit(float(max(1, total - warm)))))
    return F.when(epoch < warm, rising).otherwise(falling)

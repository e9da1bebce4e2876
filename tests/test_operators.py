"""Operators on tiny tables: rules, splits, joins, matching, metrics."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from annolith import vocab as V
from annolith.operators import aggregates as A
from annolith.operators import coverage as C
from annolith.operators import dedup as D
from annolith.operators import matching as M
from annolith.operators import metrics as T
from annolith.operators import rules as R
from annolith.operators import splits as S

GOOD = dict(zip(V.META_COLUMNS, ["images/real/a.jpg", "A123BC77", "type1", "10", "20", "40", "10", "10", "20", "50", "20", "50", "30", "10", "30", "true", "false", "own", "CC BY 4.0", "day|rain"], strict=True))


def found(spark, **change):
    row = {**GOOD, **change}
    df = spark.createDataFrame([tuple(row[c] for c in V.META_COLUMNS)], V.META).withColumn("line", F.lit(2))
    return {r.rule_id for r in R.findings(R.typed(df), R.meta_rules({"bad": "no"}), F.col("line")).collect()}


CASES = [
    ({}, set()), ({"image": ""}, {"image_empty"}), ({"image": "../x.jpg"}, {"image_outside"}), ({"image": "x/y.jpg"}, {"image_prefix"}),
    ({"image": "images/synthetic/syn_1_00001.jpg"}, {"image_superseded", "image_synthetic_flag"}), ({"is_synthetic": "yes"}, {"image_real_flag"}),
    ({"plate_type": ""}, {"type_empty"}), ({"plate_type": "typo"}, {"type_unknown"}), ({"plate_num": ""}, {"plate_empty"}), ({"plate_num": "###"}, {"plate_unreadable"}),
    ({"image": "images/synthetic/a.jpg", "is_synthetic": "1", "plate_num": "AB12377"}, {"plate_grammar"}), ({"image": "images/synthetic/a.jpg", "is_synthetic": "1", "plate_num": "A#23BC77"}, set()),
    ({"is_vehicle": ""}, {"is_vehicle_empty"}), ({"is_vehicle": "perhaps"}, {"is_vehicle_unparsable"}), ({"conditions": "day|fog"}, {"tag_unknown"}), ({"conditions": "day|day"}, {"tag_repeated"}),
    ({"conditions": "day,Night"}, {"tag_day_night"}), ({"source": ""}, {"source_blank"}), ({"license": ""}, {"license_blank"}), ({"source": "bad"}, {"source_rejected"}),
    ({"license": "CC BY-NC 4.0"}, {"license_barred"}), ({"license": "Mine"}, {"license_unconfirmed"}), ({"bbox_x": "x"}, {"bbox_numeric"}), ({"bbox_x": "-1"}, {"bbox_origin", "quad_bbox"}),
    ({"bbox_w": "0"}, {"bbox_size"}), ({"quad_x1": "nan"}, {"quad_numeric"}), ({"quad_x2": "10", "quad_y2": "20"}, {"quad_repeated"}),
    ({"quad_x2": "20", "quad_y2": "20", "quad_x3": "30", "quad_y3": "20", "quad_x4": "40", "quad_y4": "20"}, {"quad_degenerate"}),
    ({"quad_x1": "10", "quad_y1": "30", "quad_x2": "50", "quad_y2": "30", "quad_x3": "50", "quad_y3": "20", "quad_x4": "10", "quad_y4": "20"}, {"quad_counter_clockwise"}),
    ({"quad_x3": "90"}, {"quad_bbox"}), ({"plate_type": "other", "plate_num": "", **{c: "0" for c in (*V.BBOX_COLUMNS, *V.QUAD_COLUMNS)}}, set()),
]


@pytest.mark.parametrize("change, expected", CASES, ids=[str(i) for i in range(len(CASES))])
def test_row_rules(spark, change, expected):
    assert found(spark, **change) == expected


def test_header():
    assert R.header_findings(list(V.META_COLUMNS)) == []
    said = R.header_findings([*V.META_COLUMNS[1:], "extra", "extra"])
    assert [s for s, _ in said] == ["error", "warning", "error"] and "image" in said[0][1]


def test_records_and_candidates(spark):
    record = {c: "x" for c in V.RECORD_FIELDS} | {c: "yes" for c in V.PERMISSION_FIELDS} | {"decision": "accept_for_submission", "stated_license": "CC0;CC BY 4.0", "privacy_review": "completed"}
    df = spark.createDataFrame([tuple(record[c] for c in V.RECORD_FIELDS)], ", ".join(f"{c} string" for c in V.RECORD_FIELDS))
    problems = lambda d: d.select(R.record_problems(d.columns)).first()[0]
    assert problems(df) == []
    assert "unclear" in problems(df.withColumn("redistribution_allowed", F.lit("")))[0] and len(problems(df.withColumn("stated_license", F.lit("CC BY-SA 4.0")))) == 1
    assert problems(df.drop("notes")) == ["missing field 'notes'"]
    good = {c: "x" for c in V.CANDIDATE_FIELDS} | {"redistribution_status": "yes", "modification_status": "yes", "is_real_photo": "yes", "plate_class": "OTHER", "decision": "ACCEPT_FOR_SUBMISSION", "provenance_status": "VERIFIED_ON_SOURCE", "license": "CC BY 4.0"}
    cand = spark.createDataFrame([tuple(good[c] for c in V.CANDIDATE_FIELDS)], V.CANDIDATE_MANIFEST)
    say = lambda d: d.select(R.candidate_problems(d.columns)).first()[0]
    assert say(cand) == [] and len(say(cand.withColumn("attribution", F.lit("")))) == 1 and len(say(cand.withColumn("plate_class", F.lit("AMBIGUOUS")))) == 1


def test_live_sources(spark):
    approved = spark.createDataFrame([("https://c/wiki/File:A.jpg", "CC BY 4.0"), ("https://c/wiki/File:B.jpg", "CC0"), ("https://c/wiki/File:C.jpg", "CC0")], "file_page_url string, license string")
    live = spark.createDataFrame([("File:A.jpg", "cc-by-4.0", "image/jpeg", "", "u"), ("File:B.jpg", "CC BY-SA 4.0", "image/gif", "x", "")], "title string, license string, mime string, restrictions string, url string")
    got = {r.title: r for r in C.live_status(approved, live).collect()}
    assert got["File:A.jpg"].status == "VERIFIED" and len(got["File:B.jpg"].problems) == 4 and "not found" in got["File:C.jpg"].problems[0]


def test_splits_do_not_depend_on_order(spark):
    rows = [(f"i{i}", f"g{i % 17}") for i in range(300)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "image string, stratum string")
    one = {r.image: r.split for r in S.stratified_split(df, "image", ["stratum"]).collect()}
    two = {r.image: r.split for r in S.stratified_split(df.repartition(7).orderBy("image"), "image", ["stratum"]).collect()}
    assert one == two
    for g, members in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        n = [one[i] for i, _ in members]
        assert n.count("train") == round(len(n) * 0.85)


def test_manifest_grows_frozen(spark):
    frozen = spark.createDataFrame([("a", "g1", "holdout", "s", "d1", "n"), ("z", "g9", "val", "s", "d1", "")], V.SPLIT_MANIFEST)
    items = spark.createDataFrame([("a", "g1", "new"), ("b", "g1", "new"), ("c", "g2", "new")], "image string, `group` string, source string")
    got = {r.image: r for r in S.grow_manifest(items, frozen, 7, assigned_on="d2").collect()}
    assert got["a"].split == got["b"].split == "holdout" and got["a"].assigned_on == "d1" and got["b"].assigned_on == "d2" and got["z"].split == "val"
    assert not any(r.conflict for r in got.values())
    moved = S.grow_manifest(items.withColumn("group", F.lit("g2")), frozen, 7).filter("conflict").collect()
    assert [r.image for r in moved] == ["a"]


def test_holdout_is_guarded(spark):
    df = spark.createDataFrame([("a", "holdout")], "image string, split string")
    with pytest.raises(PermissionError):
        S.load_split(df, "holdout")
    assert S.load_split(df, "holdout", "final measurement").count() == 1


def greedy(truth, predicted, t):
    area = lambda b: b[2] * b[3]

    def iou(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        u = area(a) + area(b) - w * h
        return w * h / u if u > 0 else 0.0

    used, out = set(), []
    for p in sorted(range(len(predicted)), key=lambda i: -predicted[i][1]):
        best = max(((iou(b, predicted[p][0]), k) for k, b in enumerate(truth) if k not in used), default=(0, -1))
        if best[0] >= t and best[1] >= 0:
            used.add(best[1])
            out.append((best[1], p))
    return out


def test_greedy_matching(spark):
    rng = random.Random(2)
    boxes = lambda n: [tuple(float(rng.randrange(0, 30, 5)) for _ in range(2)) + tuple(float(rng.randrange(5, 25, 5)) for _ in range(2)) for _ in range(n)]
    images = [(i, boxes(rng.randrange(5)), [(b, rng.randrange(4) / 4) for b in boxes(rng.randrange(5))]) for i in range(150)]
    box = "struct<x:double,y:double,w:double,h:double>"
    df = spark.createDataFrame(
        [(i, [(k, b) for k, b in enumerate(t)], [(k, s, b) for k, (b, s) in enumerate(p)]) for i, t, p in images],
        f"image int, truth array<struct<ordinal:int,box:{box}>>, predictions array<struct<ordinal:int,score:double,box:{box}>>",
    )
    got = {r.image: [(m.t, m.p) for m in r.m] for r in M.matched_images(df.select("image", "truth"), df.select("image", "predictions"), "image", 0.3).withColumnRenamed("matches", "m").collect()}
    assert got == {i: greedy(t, p, 0.3) for i, t, p in images}


def test_metrics(spark):
    w = spark.range(1).select(T.wilson(F.lit(0), F.lit(0)), T.wilson(F.lit(5), F.lit(5)), T.rates(F.lit(0), F.lit(3), F.lit(2))).first()
    assert tuple(w[0]) == (0.0, 1.0) and w[1].high == 1.0 and w[1].low == pytest.approx(0.5655, abs=1e-4) and tuple(w[2]) == (0.0, 0.0, None)
    scored = spark.createDataFrame([("a", 0.9, True, 1), ("a", 0.8, False, 2), ("a", 0.7, True, 3), ("b", 0.5, False, 1)], "k string, s double, tp boolean, i int")
    ap = {r.k: r.ap for r in T.average_precision(scored, F.max(F.lit(4)), ["k"], "s", "tp", ["i"]).collect()}
    assert ap == pytest.approx({"a": (1 + 2 / 3) / 4, "b": 0.0})


def test_percentiles_and_duplicates(spark):
    df = spark.createDataFrame([("a", float(v), v) for v in (5, 1, 3, 3)], "k string, v double, i int")
    assert {r.share: r.value for r in A.nearest_rank(df, "v", [0.0, 0.5, 1.0], ["k"]).collect()} == {0.0: 1.0, 0.5: 3.0, 1.0: 5.0}
    assert [(r.v, r.n) for r in D.duplicate_keys(df, "v").collect()] == [(3.0, 2)]
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.5]), (3, [3.0, 1.0, 2.0]), (4, [1.0, 1.0]), (5, None), (6, [7.0, 7.0, 7.0])], "id int, v array<double>")
    exact = {(r.first, r.second) for r in D.correlated_pairs(vectors, "id", "v", 0.97).collect()}
    assert exact == {(1, 2)} and {(r["first"], r["second"]) for r in D.banded_pairs(vectors, "id", "v", 0.97).collect()} == exact


def test_reachable_stops_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "parent string, child string")
    got = {r.node: r.depth for r in C.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}

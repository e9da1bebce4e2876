"""Scalars against values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annolith.functions import geometry as G
from annolith.functions import hashing as H
from annolith.functions import sequences as Q
from annolith.functions import text as X


def values(spark, column, rows, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_cells(spark):
    c = F.col("c")
    assert values(spark, X.parse_bool(c), [" TRUE", "0", "maybe", "", None]) == [True, False, None, None, None]
    numbers = {"1_0": 10.0, "1,5": 1.5, "1.5d": None, "nan": None, "inf": None, "1e999": None, " -.5 ": -0.5, "": None, "1__0": None, "7.": 7.0}
    assert values(spark, X.parse_number(c), list(numbers)) == list(numbers.values())
    assert values(spark, X.split_tags(c), ["Day| night ,,x", ""]) == [["day", "night", "x"], []]


def test_licences(spark):
    c = F.col("c")
    names = ["CC-BY-4.0", "Creative Commons Attribution 4.0 International", "noncommercial", "non-commercial", "CC BY-SA;CC BY 4.0", "CC BY-SA 2.0;x", ""]
    assert values(spark, X.normal_license(c), names[:2]) == ["cc by 4.0"] * 2
    assert values(spark, X.license_clause(c), names) == [None, None, "non-commercial", None, None, "share-alike", None]
    assert values(spark, X.gate_verdict(c), ["CC BY 4.0", "GPL", "some", " "]) == ["COMPATIBLE", "INCOMPATIBLE", "UNKNOWN", "UNKNOWN"]
    assert values(spark, X.squeezed_license(c), ["CC0 1.0", "cc-by_4.0", "PD"]) == ["cc0", "ccby4.0", "public domain"]
    assert values(spark, X.all_redistributable(c), ["CC0; CC BY 4.0", "CC0; mine", ";"]) == [True, False, False]


PLATES = {
    "а123вс77": (True, "A123BC77", "type1"), "A 123-BC_777": (True, "A123BC777", "type1"), "A123BC377": (False, "A123BC377", ""), "A123BC00": (False, "A123BC00", ""),
    "AB12377": (True, "AB12377", "type1b"), "AB123777": (False, "AB123777", ""), "D123BC77": (False, "D123BC77", ""), " ": (False, "", ""),
}


def test_plates(spark):
    got = values(spark, X.validate_plate(F.col("c")), list(PLATES))
    assert [(r.is_valid, r.normalized, r.format) for r in got] == list(PLATES.values())
    typed = values(spark, X.validate_plate(F.col("c"), F.lit("type1b")), ["A123BC77", "AB12377"])
    assert [r.is_valid for r in typed] == [False, True] and "does not match" in typed[0].reason


def test_masks_and_codes(spark):
    c = F.col("c")
    assert values(spark, X.mask_positions(c, F.array(F.lit(0), F.lit(2))), ["abc", ""]) == ["#b#", ""]
    assert values(spark, X.mask_unconfident(c, F.array(F.lit(0.9), F.lit(0.1)), 0.5), ["ab", "abc"]) == ["a#", None]
    assert values(spark, X.encode(c, "ABC"), ["CAB", "AX", "A" * 10]) == [[3, 1, 2], None, None]
    assert values(spark, X.decode(X.encode(c, "ABC"), "ABC"), ["CAB"]) == ["CAB"]


def test_urls_and_markup(spark):
    c = F.col("c")
    urls = ["https://x.org/wiki/File:A_b%20c+d.jpg?utm=1", "http://x/a/..%2Fb%3A.png", "http://x/"]
    assert values(spark, X.url_title(c), urls[:1]) == ["File:A b c+d.jpg"]
    assert values(spark, X.url_filename(c), urls) == ["File_A_b c+d.jpg", "_b_.png", "download.bin"]
    assert values(spark, X.strip_markup(c), ["a <b>c</b>  d", "x <a <b>> y", None]) == ["a c d", "x y", ""]


def test_hashes(spark):
    score = spark.range(1).select(H.hash_score(F.lit("session-01"), 7), H.derived_seed(F.lit(1), F.lit("a")), H.derived_seed(F.lit(20260913), F.lit("sample"), F.lit(0))).first()
    assert score[0] == 0.3769431752570218 and int(score[1]) == 0x22E4A339DDFD6241 and int(score[2]) == 0xBE2CE4478C73B894
    keys = [f"k{i}" for i in range(200)]
    expected = [int.from_bytes(hashlib.sha256(f"5:{k}".encode()).digest()[:8], "big") / 2**64 for k in keys]
    assert values(spark, H.hash_score(F.col("c"), 5), keys) == expected


def test_edges():
    assert H.cumulative_edges({"train": 1, "val": 1}, ("train", "val", "holdout"))[1:] == [("val", 1.0), ("holdout", 1.0)]
    for bad in ({"x": 1}, {"train": -1, "val": 2}, {"train": 0}):
        with pytest.raises(ValueError):
            H.cumulative_edges(bad, ("train", "val"))


def test_geometry(spark):
    q = F.array(*(F.lit(float(v)) for v in (0, 0, 40, 0, 40, 10, 0, 10)))
    row = spark.range(1).select(
        G.signed_area(q), G.quad_aspect(q), G.is_convex(q), G.quad_extent(q), G.is_two_line(q),
        G.iou(G.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), G.box(F.lit(1), F.lit(0), F.lit(2), F.lit(2))), G.iou(*[G.box(*[F.lit(0)] * 4)] * 2),
        G.yolo_line(G.box(F.lit(-10), F.lit(0), F.lit(60), F.lit(50)), F.lit(100), F.lit(100), F.lit(3)), G.hex_colour(G.to_rgb(F.lit(255.0), F.lit(128.0), F.lit(128.0))),
        G.quad_from_crop(G.quad_in_crop(q, G.box(F.lit(5), F.lit(2), F.lit(10), F.lit(4))), G.box(F.lit(5), F.lit(2), F.lit(10), F.lit(4))),
    ).first()
    assert row[0] == 400.0 and row[1] == 4.0 and row[2] and tuple(row[3]) == (0.0, 0.0, 40.0, 10.0) and not row[4]
    assert row[5] == pytest.approx(1 / 3) and row[6] == 0.0 and row[7] == "3 0.250000 0.250000 0.500000 0.500000" and row[8] == "#ffffff"
    assert row[9] == pytest.approx([0, 0, 40, 0, 40, 10, 0, 10])


def test_sequences(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2, 2, 0],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(Q.collapse(F.col("c"))).collect()] == [[1, 1, 2], []]
    steps = spark.createDataFrame([([(1, 0.5), (1, 0.9), (0, 0.8), (1, 0.7)],)], "c array<struct<code:int,score:double>>")
    assert [tuple(x) for x in steps.select(Q.best_path(F.col("c"))).first()[0]] == [(1, 0.9), (1, 0.7)]
    soft = spark.range(1).select(Q.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert soft == [0.5, 0.5]

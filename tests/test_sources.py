"""Sources and sinks on files written here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from annolith import vocab as V
from annolith.plans import inference as P
from annolith.sources import files as L
from annolith.sources import sinks as K
from annolith.sources import tables as S


def test_meta_lines_and_widths(spark, tmp_path):
    header = ";".join(V.META_COLUMNS)
    (tmp_path / "meta.csv").write_text("﻿" + header + "\n\nimages/real/a.jpg;A1;type1\n" + ";".join(["q"] * 21) + '\n"x;y";"say ""hi"""\n', encoding="utf-8")
    got = S.read_meta(spark, str(tmp_path / "meta.csv")).orderBy("line").collect()
    assert [(r.line, r.cell_count) for r in got] == [(3, 3), (4, 21), (5, 2)]
    assert got[0].image == "images/real/a.jpg" and got[0].conditions == "" and (got[2].image, got[2].plate_num) == ("x;y", 'say "hi"')
    with pytest.raises(S.SourceError):
        S.read_meta(spark, str(tmp_path / "absent.csv"))
    assert S.read_split_manifest(spark, str(tmp_path / "absent.csv")).count() == 0


def test_predictions_wrapped_or_bare(spark, tmp_path):
    images = [{"image": "a", "detections": [{"bbox": [1, 2, 3, 4], "confidence": 0.5}]}, {"image": "a", "detections": [{"bbox": [0, 0, 1, 1], "confidence": 0.9}]}]
    (tmp_path / "bare.json").write_text(json.dumps(images))
    (tmp_path / "wrapped.json").write_text(json.dumps({"predictions": images}))
    for name in ("bare", "wrapped"):
        got = S.read_predictions(spark, str(tmp_path / f"{name}.json")).collect()
        assert [(r.image, r.ordinal, r.confidence) for r in got] == [("a", 0, 0.9)]


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 40, 20) + b"\x08\x02\0\0\0" + b"crc_" + b"\0\0\0\0IEND\xaeB`\x82"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 60) + b"\x01\x01\x11\x00" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<I", 60) + b"\0" * 4 + struct.pack("<I", 54) + struct.pack("<Iii", 40, 7, -9) + b"\0" * 34


@pytest.fixture
def root(tmp_path):
    for name, data in {
        "images/a.jpg": JPEG, "images/b.png": PNG, "images/c.bmp": BMP, "images/d.jpg": PNG, "images/e.png": PNG[:-6], "images/f.jpg": b"", "images/g.jpg": b"GIF89a..", "more/a.jpg": JPEG,
        "labels/a.txt": b"0 0.5 0.5 0.2 0.2\n# note\n1 0.1 0.1 0.5 0.1\n2 0 0 1 0 1 1\n", "labels/b.txt": b"hello world\n", "labels/z.txt": b"0 .5 .5 .1 .1",
        "data.yaml": b"nc: 2\nnames:\n  - car\n  - 'truck'\ntrain: x\n", "classes.txt": b"one\n\ntwo\n", "README.dataset.txt": b"  About  ", "t.csv": b"a|b\n1|2\n|\n3|4\n", "x.bin": b"",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_directory_audit(spark, root):
    report = L.audit(spark, root)
    images = {r.name: r for r in report["images"].collect()}
    assert (images["images/a.jpg"].width, images["images/a.jpg"].height) == (60, 30) and images["images/a.jpg"].problems == []
    assert (images["images/b.png"].width, images["images/c.bmp"].height) == (40, 9)
    assert images["images/d.jpg"].warnings and "truncated" in images["images/e.png"].problems[0] and images["images/f.jpg"].problems == ["file is empty"] and "47494638" in images["images/g.jpg"].problems[0]
    labels = {r.name: r for r in report["annotations"].collect()}
    assert len(labels["labels/a.txt"].boxes) == 2 and "horizontally" in labels["labels/a.txt"].invalid[0].reason and labels["labels/a.txt"].invalid[0].line == 3
    assert not labels["labels/b.txt"].is_yolo
    configs = {r.name: r for r in report["configs"].collect()}
    assert configs["data.yaml"].names == {0: "car", 1: "truck"} and configs["data.yaml"].declared == 2 and configs["classes.txt"].names == {0: "one", 1: "two"}
    csv = report["csv"].first()
    assert (csv.delimiter, csv.header, csv.row_count) == ("|", ["a", "b"], 2)
    assert report["metadata"].first().preview == "About" and [r.name for r in report["other"].collect()] == ["x.bin"]
    pairing = {(r.state, r.stem) for r in report["pairing"].collect()}
    assert ("label_without_image", "z") in pairing and ("ambiguous", "a") in pairing and ("image_without_label", "b") in pairing
    assert {tuple(r.names) for r in report["same_bytes"].collect()} == {("images/a.jpg", "more/a.jpg"), ("images/b.png", "images/d.jpg")}


def test_submission(spark, tmp_path):
    df = spark.createDataFrame([("b.jpg", "X", "type1", 2.0, 0), ("a.jpg", "A123BC77", "type1", 0.9123, 1), ("a.jpg", "Y", "other", 0.0625, 0)], "image string, plate_num string, plate_type string, confidence double, ordinal int")
    assert K.write_submission(df, str(tmp_path / "out")) == 3
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "a.jpg;Y;other;0.062\na.jpg;A123BC77;type1;0.912\nb.jpg;X;type1;1.000\n"
    with pytest.raises(K.UnsafeOutput):
        K.refuse_inside("/data/set/out", "/data/set")
    K.refuse_inside("/data/settings", "/data/set")


def test_frozen_digest(spark):
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "image string, sha256 string")
    assert K.check_frozen(files.orderBy("image"), K.frozen(files)) == []
    assert K.check_frozen(files.filter("image = 'a'"), K.frozen(files))


def test_inference_isolates_failures(spark):
    images = spark.createDataFrame([("ok", bytearray(b"good")), ("bad", bytearray(b"boom")), ("none", bytearray(b""))], "name string, content binary")

    def make():
        def stage(data):
            if data == b"boom":
                raise ValueError("broken")
            box = {"x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "detection": 0.9, "plate_type": "type1", "type_confidence": 1.0, "text_confidence": 0.5}
            return [box | {"plate_num": "A123BC77"}, box | {"plate_num": "??"}, box | {"plate_num": ""}] if data else []

        return stage

    readings = P.read_plates(images, make)
    got = {r.plate_num: r.confidence for r in P.records(readings).collect()}
    assert got == pytest.approx({"A123BC77": 0.45, "??": 0.225})
    assert [r.name for r in readings.filter("error is not null").collect()] == ["bad"] and P.records(readings, 0.4).count() == 1
    assert tuple(P.run_counters(readings, P.records(readings)).first()) == (1, 3, 2)


def test_streams_agree_with_batches(spark, tmp_path):
    from annolith.streaming import counts

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(source)
    stream = counts.split_stream(spark.readStream.schema(schema).parquet(source), "user_id", 3)
    query = stream.writeStream.format("memory").queryName("split_events").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = counts.split_stream(spark.read.parquet(source), "user_id", 3)
    key = lambda d: sorted((r.event_id, r.split) for r in d.select("event_id", F.col("split")).collect())
    assert key(spark.table("split_events")) == key(batch)


def grey_jpeg(levels, wide):
    """A baseline greyscale JPEG of flat 8x8 blocks: a size code of its own length for each DC size, and end-of-block alone for AC."""
    sizes = list(range(12))
    counts = [0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[sizes[k]] = format(code, f"0{length}b")
            code, k = code + 1, k + 1
        code <<= 1
    bits, last = "", 0
    for level in levels:
        value = level - 128  # quantiser 8: a DC step is one grey level
        d, last = value - last, value
        n = abs(d).bit_length()
        bits += codes[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    high = len(levels) // wide
    return (
        b"\xff\xd8" + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xC0, b"\x08" + struct.pack(">HH", 8 * high, 8 * wide) + b"\x01\x01\x11\0")
        + seg(0xC4, b"\0" + bytes(counts) + bytes(sizes)) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + seg(0xDA, b"\x01\x01\0\0\x3f\0") + body + b"\xff\xd9"
    )


def test_block_means_of_a_jpeg():
    import numpy as np

    from annolith.sources import jpeg as J

    levels = [10, 200, 128, 127, 255, 0, 90, 91, 3, 250, 250, 128]
    planes = J.dc_planes(grey_jpeg(levels, 4))
    assert np.allclose(planes[0], np.array(levels).reshape(3, 4))
    top = J.dc_planes(grey_jpeg(levels, 4), bottom=0.3)[0]
    assert np.isfinite(top[0]).all() and np.isnan(top[1:]).all()
    assert J.region_mean(planes[0], 0, 0, 0.5, 0.3) == pytest.approx(105)
    with pytest.raises(J.Undecodable):
        J.dc_planes(PNG)


def test_plate_colours(spark):
    from annolith.sources import jpeg as J

    df = spark.createDataFrame([(bytearray(grey_jpeg([100] * 64, 8)), 0.5, 0.5, 0.5, 0.2), (bytearray(PNG), 0.5, 0.5, 0.5, 0.2), (bytearray(JPEG), 0.5, 0.5, 0.5, 0.2)], "content binary, cx double, cy double, w double, h double")
    got = J.plate_colours(df).collect()
    assert "greyscale" in got[0].c.note and got[0].c.y == 100.0 and not got[0].candidate
    assert "baseline" in got[1].c.note and "not decoded" in got[2].c.note and {r.strength for r in got} == {"none"}


def test_manifest_grows_by_batch(spark, tmp_path):
    from annolith.operators import splits as S
    from annolith.streaming import counts

    place = str(tmp_path / "manifest")
    run = counts.grow(place, 7)
    batch = lambda rows: spark.createDataFrame(rows, "image string, `group` string, source string")
    run(batch([("a", "g1", "s"), ("b", "g2", "s")]), 0)
    run(batch([("a", "g9", "s"), ("c", "g1", "s"), ("c", "g1", "s"), ("d", "g3", "s")]), 1)
    run(batch([("c", "g1", "s"), ("d", "g3", "s")]), 1)
    rows = spark.read.parquet(place).collect()
    assert sorted((r.image, r.group, r.assigned_on) for r in rows) == [("a", "g1", "0"), ("b", "g2", "0"), ("c", "g1", "1"), ("d", "g3", "1")]
    split = {r.image: r.split for r in rows}
    expected = {r.g: r.s for r in spark.createDataFrame([("g1",), ("g2",), ("g3",)], "g string").withColumn("s", S.group_split(F.col("g"), 7)).collect()}
    assert split == {"a": expected["g1"], "b": expected["g2"], "c": expected["g1"], "d": expected["g3"]}

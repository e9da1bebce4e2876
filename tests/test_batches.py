"""Batches of files, label files, reports and pages, paged answers, settings and perspective maps."""

import hashlib
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith import config, vocab
from annolith.functions import geometry as G
from annolith.functions import projective as P
from annolith.operators import review
from annolith.sources import batches, pages, reports, web
from annolith.sources.sinks import UnsafeOutput
from tests.test_operators import GOOD


def samples(spark, n=3):
    rows = [(*(f"images/s{k}.jpg" if c == "image" else ('a;"b' if c == "source" else GOOD[c]) for c in vocab.META_COLUMNS), bytes([k]) * 5, json.dumps({"b": k, "a": "ü"})) for k in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in vocab.META_COLUMNS) + ", content binary, record string")


def test_batch_is_written_and_replaced(spark, tmp_path):
    root = str(tmp_path / "batch")
    head = batches.write_batch(samples(spark), root)
    manifest = json.loads((tmp_path / "batch/manifest.json").read_text())
    assert {k: v for k, v in manifest.items() if k != "files"} == head and head["images"] == 3
    files = {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "batch").rglob("*") if p.is_file() and p.name != "manifest.json"}
    assert manifest["files"] == files and manifest["complete"] and manifest["by_plate_type"] == {"type1": 3}
    assert {(r.path, r.sha256) for r in batches.read_manifest(spark, root).collect()} == set(files.items())
    assert (tmp_path / "batch/records.jsonl").read_text().splitlines()[0] == '{"a": "ü", "b": 0}'
    assert '"a;""b"' in (tmp_path / "batch/meta.csv").read_text().splitlines()[1]
    with pytest.raises(UnsafeOutput):
        batches.write_batch(samples(spark), root)
    (tmp_path / "batch/own.txt").write_text("mine")
    batches.write_batch(samples(spark, 2), root, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "batch/images").iterdir()) == ["s0.jpg", "s1.jpg"] and (tmp_path / "batch/own.txt").read_text() == "mine"


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", range(12))
def test_a_batch_interrupted_at_any_step_is_cleared(spark, tmp_path, monkeypatch, step):
    """Every call that changes the folder from the driver fails in turn; tasks are stopped between their journal and their files."""
    root, left = str(tmp_path / "batch"), [step]
    (tmp_path / "batch").mkdir()

    def stopping(f):
        def run(*args, **kwargs):
            left[0] -= 1
            if left[0] < 0:
                raise Stopped
            return f(*args, **kwargs)

        return run

    with monkeypatch.context() as m:
        for name in ("put", "joined", "digest_of"):
            m.setattr(batches, name, stopping(getattr(batches, name)))
        m.setattr(batches.json, "loads", stopping(batches.json.loads)) if step == 11 else None
        try:
            batches.write_batch(samples(spark, 5), root)
        except Exception as stopped:  # noqa: BLE001 - of tasks Spark tells in its own words
            assert isinstance(stopped, Stopped) or "Stopped" in str(stopped) or step == 11
    (tmp_path / "batch/own.txt").write_text("mine")
    if not (tmp_path / "batch/manifest.json").exists():
        (tmp_path / "batch/own.txt").unlink()
        for p in (tmp_path / "batch").rglob("*.part"):
            p.unlink()
    batches.write_batch(samples(spark, 2), root, overwrite=True)
    kept = {p.relative_to(tmp_path / "batch").as_posix() for p in (tmp_path / "batch").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert kept - {"own.txt"} == {"images/s0.jpg", "images/s1.jpg", "manifest.json", "meta.csv", "records.jsonl"}


def test_what_an_interrupted_batch_journalled_goes(spark, tmp_path):
    root = str(tmp_path / "batch")
    batches.begin(root, False)
    batches.put(root, "_journal/x", b'["images/old_1.jpg", "images/old_2.jpg", "../out.txt"]')
    batches.put(root, "images/old_1.jpg", b"1")
    (tmp_path / "batch/images/old_2.jpg.part").write_bytes(b"2")
    (tmp_path / "batch/images/other.jpg").write_bytes(b"3")
    (tmp_path / "out.txt").write_text("outside")
    batches.write_batch(samples(spark, 1), root, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "batch/images").iterdir() if not p.name.startswith(".")) == ["other.jpg", "s0.jpg"]
    assert (tmp_path / "out.txt").read_text() == "outside" and not (tmp_path / "batch/_journal").exists()


def test_foreign_folders_are_left_alone(tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/file").write_text("1")
    for overwrite in (False, True):
        with pytest.raises(UnsafeOutput):
            batches.begin(str(tmp_path / "x"), overwrite)
    (tmp_path / "x/manifest.json").write_text('{"writer": "other", "files": {"file": ""}}')
    with pytest.raises(UnsafeOutput):
        batches.begin(str(tmp_path / "x"), True)
    assert (tmp_path / "x/file").read_text() == "1"


def test_label_and_list_files(spark, tmp_path):
    rows = [("a/1.jpg", 1, "0 x", "train"), ("a/1.jpg", 0, "0 y", "train"), ("a/2.jpg", 0, None, "train"), ("a/3.png", 0, "0 z", "val")]
    df = spark.createDataFrame(rows, "image string, ordinal int, line string, split string")
    found = {r.path for r in batches.write_label_files(df, str(tmp_path / "out"), "image", "ordinal", F.col("line"), "split").collect()}
    assert found == {"labels/train/1.txt", "labels/train/2.txt", "labels/val/3.txt", "lists/train.txt", "lists/val.txt"}
    assert (tmp_path / "out/labels/train/1.txt").read_text() == "0 y\n0 x\n" and (tmp_path / "out/lists/train.txt").read_text() == "a/1.jpg\na/2.jpg\n"


def test_digests_and_hashes(spark, tmp_path):
    images = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", "h2")], "image string, sha256 string")
    batches.write_digests(images, str(tmp_path / "d"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "d").glob("part*"))).replace("image;sha256\n", "") == "a;h1\nb;h1\nc;h2\n"
    got = batches.dataset_hashes(images.filter("image <> 'c'"), images)
    assert [tuple(r) for r in got.collect()] == [("h1", "b")]


def test_reports(spark):
    checks = spark.createDataFrame([("stale", 0), ("spans", 2)], "check string, n long")
    assert reports.split_audit_report(checks).endswith("problems found\n") and reports.split_audit_report(checks.filter("n = 0")).endswith("clean\n")
    many = spark.range(70).select(F.format_string("f%02d", "id").alias("finding"))
    counts = spark.createDataFrame([("a", 1)], "k string, n int")
    text = reports.manifest_report("m.csv", {"by class": counts}, many)
    assert "f59" in text and "f60" not in text and "and 10 more" in text and text.endswith("blocked\n")
    assert "and 45 more" in reports.external_audit_report("/r", counts, {"unreadable": many})
    assert reports.staged_source_report("s", counts, many.limit(0), many.limit(1)).endswith("the decision is a person's\n")
    assert reports.leakage_report(counts, {"hash": many.limit(0)}).endswith("clean\n")
    metrics = spark.createDataFrame([("real:val", "recall", 0.5, 0.4, 0.6, 10), ("real:val", "ap", None, None, None, None)], "population string, metric string, value double, low double, high double, total int")
    text = reports.evaluation_report("v1", metrics)
    assert "0.5000  (0.400 to 0.600, n = 10)" in text and "n/a" in text


def items(spark):
    images = spark.createDataFrame([("<a>", 1000, 500, True, True), ("b", 100, 100, False, False), ("c", 10, 10, True, False)], "image string, width int, height int, readable boolean, renamed boolean")
    boxes = spark.createDataFrame([("<a>", 0, 0.5, 0.5, 0.05, 0.05), ("<a>", 1, 0.1, 0.5, 0.2, 0.1), ("b", 0, 0.5, 0.5, 0.1, 0.1)], "image string, ordinal int, cx double, cy double, w double, h double")
    return review.review_items(images, boxes), boxes


def test_review_items_and_pages(spark):
    found, boxes = items(spark)
    got = {r.image: r for r in found.collect()}
    assert got["<a>"].flags == ["extension_mismatch", "multiple_plates", "one_line_shape", "plate_touches_edge"] and got["<a>"].aspect == pytest.approx(4.0)
    assert got["b"].flags == ["unreadable_image"] and got["c"].flags == ["no_annotation"]
    cards = pages.cards(found.withColumn("notes", review.machine_facts(found)), boxes, blank_verdict=True)
    text = pages.page("T & <x>", cards)
    assert "T &amp; &lt;x>" in text and "&lt;a&gt;" in text and "<a>" not in text.split("</style>")[1] and text.count('class="box"') == 3 and text.count("verdict:") == 3
    assert "left:0.000%;top:45.000%;width:20.000%;height:10.000%" in text
    assert "median aspect: 4.00" in reports.shape_statistics_report(found)


def test_answers_are_paged_and_tried_again():
    asked, slept = [], []

    def opener(url, headers):
        asked.append(url)
        if len(asked) == 1:
            raise OSError("busy")
        return io.BytesIO(json.dumps({"n": len(asked), **({"continue": {"from": "x"}} if len(asked) == 2 else {})}).encode())

    assert [a["n"] for a in web.pages("http://h/api", {"q": "1"}, opener, sleep=slept.append)] == [2, 3]
    assert slept == [1.0] and asked[0] == asked[1] and "from=x" in asked[2]
    with pytest.raises(web.FetchError):
        web.fetch("u", lambda *_: (_ for _ in ()).throw(OSError("down")), tries=2, sleep=slept.append)
    assert list(web.batches("abcab", 2)) == [["a", "b"], ["c"]]


def test_settings():
    rules = {"p": lambda n, v: config.probabilities(n, v, ["rain"]), "r": lambda n, v: config.interval(n, v, 0, 9), "w": lambda n, v: config.weights(n, v, ["a"])}
    good = {"p": {"rain": 0.5}, "r": [1, 2], "w": {"a": 1}}
    assert config.checked(good, rules) == good
    with pytest.raises(config.ConfigError, match="p.rain.*r is out of order.*w sums to 0"):
        config.checked({"p": {"rain": 2}, "r": [2, 1], "w": {"a": 0}}, rules)
    assert config.overlaid({"a": {"b": 1, "c": 2}, "d": 3}, {"_note": 1, "a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    for bad in ({"x": 1}, {"a": {"x": 1}}, {"a": 5}):
        with pytest.raises(config.ConfigError):
            config.overlaid({"a": {"b": 1}}, bad)
    assert config.pairs("a=1, b=2", "ab") == {"a": 1.0, "b": 2.0} and config.size("640X480") == (640, 480)
    for text in ("", "a", "c=1", "a=x"):
        with pytest.raises(config.ConfigError):
            config.pairs(text, "ab")


def test_perspective(spark):
    quad, unit = [10.0, 20.0, 110.0, 25.0, 105.0, 60.0, 8.0, 50.0], [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    df = spark.createDataFrame([(quad, unit), (unit, quad), ([1.0] * 8, unit), (None, unit)], "s array<double>, t array<double>").withColumn("c", P.perspective("s", "t"))
    points = [P.mapped(F.col("c"), F.get("s", F.lit(2 * k)), F.get("s", F.lit(2 * k + 1))) for k in range(4)]
    rows = df.select("t", "c", F.array(*points).alias("m")).collect()
    for r in rows[:2]:
        assert [v for p in r.m for v in p] == pytest.approx(r.t, abs=1e-9)
    assert rows[2].c is None and rows[3].c is None
    turn = P.rotation(30, 20, 10)
    assert turn @ turn.T == pytest.approx(np.eye(3)) and np.linalg.det(turn) == pytest.approx(1.0)
    assert P.rotation(30, 0, 0)[0] == pytest.approx([math.cos(math.pi / 6), 0, 0.5])
    assert P.projected(np.array([[1.0, 2.0]]), np.eye(3), 5.0).tolist() == [[1.0, 2.0]]


def test_keypoint_line_of_a_box_outside(spark):
    row = spark.range(1).select(G.keypoint_line(G.box(F.lit(200.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)), F.array(*(F.lit(0.0) for _ in range(8))), F.lit(100.0), F.lit(100.0)).alias("l")).first()
    assert row.l is None

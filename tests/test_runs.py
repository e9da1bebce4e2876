"""Runs: stages with a model session, timings, predictions written and scored, bundles, commands."""

import zipfile

import pytest
from pyspark.sql import functions as F

from annolith import __main__ as command
from annolith import vocab as V
from annolith.operators.aggregates import run_stats
from annolith.plans import inference as N
from annolith.sources import bundles, tables
from tests.test_operators import GOOD


def stage():
    def read(data):
        if data == b"bad":
            raise ValueError("odd")
        return [{"x": 10.0, "y": 20.0, "w": 40.0, "h": 10.0, "detection": 0.9, "plate_type": "type1", "type_confidence": 1.0, "plate_num": "A123BC77", "text_confidence": 1.0}] * len(data)

    return read


def images(spark):
    return spark.createDataFrame([("images/real/a.jpg", b"1"), ("b", b"bad"), ("c", b"22")], "name string, content binary")


def test_predictions_are_written_and_scored(spark, tmp_path, capsys):
    readings = N.read_plates(images(spark), stage)
    N.write_predictions(readings, str(tmp_path / "p"), 0.5)
    got = tables.read_predictions(spark, str(tmp_path / "p")).collect()
    assert sorted((r.image, r.ordinal, r.format_valid, r.below_operating) for r in got) == [("c", 0, True, False), ("c", 1, True, False), ("images/real/a.jpg", 0, True, False)]
    (tmp_path / "meta.csv").write_text(";".join(V.META_COLUMNS) + "\n" + ";".join(GOOD[c] for c in V.META_COLUMNS) + "\n")
    found = command.scored(spark, str(tmp_path / "meta.csv"), str(tmp_path / "p"), 0.5)
    assert {r.outcome: r.n for r in found["outcomes"].collect()} == {"correct": 1} and found["operating"].first().recall == 1.0
    assert command.main(["score", str(tmp_path / "meta.csv"), str(tmp_path / "p")]) == 0 and "correct" in capsys.readouterr().out


def test_commands(spark, tmp_path, capsys):
    assert command.main(["queries"]) == 0 and "stratified_split" in capsys.readouterr().out
    assert command.main(["run", "group_split", "/root/testdata/sf0.001", "--out", str(tmp_path / "g")]) == 0
    assert spark.read.parquet(str(tmp_path / "g")).columns == ["conv_id", "split"]


def test_stage_times(spark):
    times = N.stage_times(images(spark), {"all": stage})
    assert sorted(r.name for r in times.collect()) == ["c", "images/real/a.jpg"] and all(r.ms >= 0 for r in times.collect())
    wide = times.groupBy("name").pivot("stage", ["all"]).agg(F.first("ms"))
    assert run_stats(wide, ["all"]).first().n == 2


def test_model_sessions_are_gated(spark):
    pytest.importorskip("onnxruntime")
    broken = N.onnx_stage(b"no model", lambda d: {}, lambda out, given: [])
    with pytest.raises(Exception, match="(?i)protobuf|model|load"):
        broken()


def test_bundles(tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/a.json").write_text("1")
    (tmp_path / "run/b.bin").write_text("2")
    names = bundles.bundle(str(tmp_path / "run"), ["*.json"], str(tmp_path / "one.zip"))
    bundles.bundle(str(tmp_path / "run"), ["*.json"], str(tmp_path / "two.zip"))
    assert names == ["a.json"] and (tmp_path / "one.zip").read_bytes() == (tmp_path / "two.zip").read_bytes()
    assert zipfile.ZipFile(tmp_path / "one.zip").read("a.json") == b"1"


def test_sheet_inputs(spark, tmp_path):
    (tmp_path / "meta.csv").write_text(";".join(V.META_COLUMNS) + "\n" + ";".join(GOOD[c] for c in V.META_COLUMNS) + "\n")
    (tmp_path / "g.jsonl").write_text('{"image": "images/real/a.jpg", "difficulty": "hard", "geometry": {"min_char_height_px": 7.5}, "hidden_positions": [1]}\n')
    row = tables.sheet_inputs(spark, str(tmp_path / "meta.csv"), str(tmp_path / "g.jsonl")).first()
    assert (row.image, row.difficulty, row.char_height, row.hidden) == ("images/real/a.jpg", "hard", 7.5, 1)
    (tmp_path / "s.csv").write_text("image;split;plate_type;difficulty;stratum\na;train;type1;easy;x\nb;val;type1;;x\n")
    assert {r.image: r.difficulty for r in tables.read_difficulty(spark, str(tmp_path / "s.csv")).collect()} == {"a": "easy", "b": "?"}


def test_a_run_is_counted_by_the_job_that_writes_it(spark, tmp_path):
    """The model sees every image once: what it was shown is counted by an accumulator."""
    shown = spark.sparkContext.accumulator(0)

    def make():
        read = stage()

        def run(data):
            shown.add(1)
            return read(data)

        return run

    counted = N.predicted_to(images(spark), make, str(tmp_path / "out"), 0.5)
    assert counted == {"failed": 1, "readings": 3, "records": 3, "written": 3} and shown.value == 3
    text = (tmp_path / "out/part-00000.csv").read_text()
    assert text == "c;A123BC77;type1;0.900\nc;A123BC77;type1;0.900\nimages/real/a.jpg;A123BC77;type1;0.900\n"
    nothing = N.predicted_to(images(spark).limit(0), make, str(tmp_path / "none"))
    assert nothing["written"] == 0 and (tmp_path / "none/part-00000.csv").read_text() == ""


def test_predict_command(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"1")
    assert command.main(["predict", str(tmp_path / "in"), str(tmp_path / "out"), "--stage", "tests.test_runs:stage"]) == 0
    assert "'written': 1" in capsys.readouterr().out and (tmp_path / "out/part-00000.csv").read_text().startswith("a.jpg;A123BC77")

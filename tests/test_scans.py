"""Files read once, and paged answers as partitions of titles."""

import hashlib
import struct

import pytest

from annolith.sources import files as FS
from annolith.sources import scans

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 5) + b"\x08\x02\0\0\0" + b"x" * 30 + b"\0\0\0\0IEND\xaeB`\x82"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"j" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 9, 12) + b"c" * 6 + b"d" * 50 + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IHHIIii", 100, 0, 0, 54, 40, 6, -4) + b"p" * 74


def folder(root):
    late = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 60002) + b"e" * 60000) * 4 + JPEG[2:]
    made = {
        "a/x.png": PNG, "a/cut.png": PNG[:-4], "a/space.png": PNG + b"\n \n", "b/y.jpg": JPEG, "b/zeros.jpeg": JPEG + b"\0" * 9000, "b/late.jpg": late, "b/cut.jpg": JPEG[:-2], "b/none.jpg": b"\xff\xd8" + b"n" * 200_000,
        "c.bmp": BMP, "c2.bmp": BMP[:60], "wrong.png": JPEG, "empty.jpg": b"", "odd.jpg": b"no image", "t.txt": b"0 0.5 0.5 0.1 0.1\n", "README.md": b"hello", "data.yaml": b"nc: 1\n", "small.bmp": b"BM123",
    }
    for name, data in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return made


def test_files_are_told_as_by_their_whole_bytes(spark, tmp_path):
    made = folder(tmp_path)
    got = {r.name: r for r in scans.scanned_files(spark, str(tmp_path)).collect()}
    assert {n: (r.length, r.sha256) for n, r in got.items()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items()}
    for name, data in made.items():
        r = got[name]
        if r.bucket == "image":
            assert (r.format, r.width, r.height, r.problems, r.warnings) == FS.inspect(data, r.extension), name
    assert (got["b/late.jpg"].width, got["b/late.jpg"].height) == (12, 9) and got["README.md"].bucket == "metadata" and got["t.txt"].format is None
    old = {r.name: (r.sha256, r.format, r.width, r.problems) for r in FS.image_records(FS.listing(spark, str(tmp_path))).collect()}
    assert old == {n: (r.sha256, r.format, r.width, r.problems) for n, r in got.items() if r.bucket == "image"}


def test_a_file_above_two_gigabytes_is_read_in_blocks(spark, tmp_path):
    with open(tmp_path / "large.png", "wb") as f:
        f.write(PNG)
        f.truncate((1 << 31) + 5)
    (tmp_path / "y.jpg").write_bytes(JPEG)
    got = {r.name: r for r in scans.scanned_files(spark, str(tmp_path)).collect()}
    assert (got["large.png"].length, got["large.png"].width) == ((1 << 31) + 5, 7) and got["large.png"].problems == ["truncated: the PNG does not end in IEND"]
    assert got["y.jpg"].problems == []


def test_an_empty_folder(spark, tmp_path):
    assert scans.scanned_files(spark, str(tmp_path)).count() == 0


@pytest.fixture
def titles(spark, tmp_path):
    names = [*(f"t{k}" for k in range(60)), "gone", " t3 ", ""]
    scans.write_title_batches(spark.createDataFrame([(n,) for n in names], "title string"), str(tmp_path / "titles"), 10)
    return str(tmp_path / "titles"), {f"t{k}" for k in range(60)} | {"gone"}


def test_answers_of_all_batches(spark, titles):
    path, names = titles
    rows = lambda: {r.title: r.answer for r in scans.saved_answers(spark, path, "http://h/api", "tests.scan_opener:saved").collect()}
    whole = rows()
    assert whole == rows()  # a batch that is asked for again gives the same rows
    assert set(whole) == names and whole["gone"] is None and whole["t3"] == '{"license": "Lt3"}'
    with pytest.raises(Exception, match="no_such"):
        scans.saved_answers(spark, path, "http://h/api", "tests.scan_opener:no_such").collect()


def test_answers_as_a_stream_are_asked_for_once(spark, titles, tmp_path):
    path, names = titles
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        stream = scans.answer_stream(spark, path, "http://h/api", "tests.scan_opener:saved")
        stream.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.title for r in spark.read.parquet(out).collect())

    assert run() == sorted(names)
    assert run() == sorted(names)
    scans.write_title_batches(spark.createDataFrame([("new",)], "title string"), path, 10)
    assert run() == sorted([*names, "new"])

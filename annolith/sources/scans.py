"""Two sources that Spark has not: folders of files read once each, and paged answers whose batches are partitions.

`scanned_files` streams every file once through its hash and keeps the first and last bytes, so that files of any size are audited in
blocks. `saved_answers` and `answer_stream` ask for a batch of titles in the task that reads it.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import files as FS
from . import web

#: Bytes of a file's start that are read at first, of its end that are kept, of a block, and of the files of one partition.
HEAD, TAIL, BLOCK, PARTITION = 1 << 16, 64, 1 << 20, 128 << 20
FILES = "path string, name string, length long, sha256 string, format string, width int, height int, problems array<string>, warnings array<string>"
ANSWERS = "title string, answer string, batch string"
#: What may follow the end mark of a JPEG and of a PNG.
ZEROS, SPACES = b"\0", b" \t\n\r\x0b\x0c"


def _open(root: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (afs.LocalFileSystem(), root)


@dataclass
class _Files(InputPartition):
    listed: tuple[tuple[str, int], ...]


def read_once(stream, length: int) -> tuple[str, bytes, bytes, bytes]:
    """(sha256, head, end without zeros, end without white space) of a stream, in blocks. The head of a JPEG grows until its frame header is in it."""
    digest, head, enough = hashlib.sha256(), b"", False
    zeros = spaces = b""
    while block := stream.read(BLOCK):
        digest.update(block)
        if not enough:
            head += block
            enough = len(head) >= HEAD and (not head.startswith(b"\xff\xd8") or _has_frame(head))
        zeros, spaces = (zeros + block).rstrip(ZEROS)[-TAIL:] or zeros, (spaces + block).rstrip(SPACES)[-TAIL:] or spaces
    return digest.hexdigest(), head, zeros, spaces


def _has_frame(head: bytes) -> bool:
    try:
        FS._jpeg(head)
    except ValueError:
        return False
    return True


def inspect(head: bytes, zeros: bytes, spaces: bytes, length: int, suffix: str) -> tuple:
    """(format, width, height, problems, warnings), as files.inspect() tells them of all bytes."""
    kind = next((k for k, (magic, _, _) in FS.FORMATS.items() if head.startswith(magic)), None)
    if kind is None:
        return FS.inspect(head[:8], suffix)
    size, problems = (None, None), []
    try:
        size = FS.FORMATS[kind][1](head)
        if min(size) <= 0:
            size, problems = (None, None), [f"a side is not above 0: {size[0]} x {size[1]}"]
    except ValueError as error:
        problems = [str(error)]
    ends = {"png": lambda: FS._cut_png(spaces), "jpeg": lambda: FS._cut_jpeg(zeros), "bmp": lambda: FS.cut_bmp(head, length)}
    expected = FS.IMAGE_FORMATS.get(suffix, kind)
    return kind, *size, problems + ends[kind](), [f"named {suffix} but is {kind}"] * (expected != kind)


class FileScan(DataSource):
    """Files below `path`: partitions of about PARTITION bytes, larger files alone in theirs."""

    @classmethod
    def name(cls) -> str:
        return "annolith_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options["path"])


class _FileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        fs, base = _open(self.root)
        found = [(i.path[len(base.rstrip("/")) + 1 :], i.size) for i in fs.get_file_info(afs.FileSelector(base, recursive=True)) if i.type == afs.FileType.File]
        out, held, size = [], [], 0
        for name, n in sorted(found, key=lambda f: (-f[1], f[0])):
            if held and size + n > PARTITION:
                out.append(_Files(tuple(held)))
                held, size = [], 0
            held.append((name, n))
            size += n
        return [*out, _Files(tuple(held))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, base = _open(self.root)
        for name, n in partition.listed:
            with fs.open_input_stream(f"{base}/{name}") as stream:
                sha, head, zeros, spaces = read_once(stream, n)
            file = name.rsplit("/", 1)[-1]
            suffix = f".{file.rsplit('.', 1)[1].lower()}" if "." in file[1:] else ""
            found = inspect(head, zeros, spaces, n, suffix) if suffix in FS.IMAGE_FORMATS else (None, None, None, [], [])
            yield f"{base}/{name}", name, n, sha, *found


def scanned_files(spark: SparkSession, root: str) -> DataFrame:
    """FILES of every file below root, with `bucket` and `extension`; images are inspected, and each file is read once, in blocks."""
    spark.dataSource.register(FileScan)
    files = spark.read.format(FileScan.name()).option("path", root).load()
    return files.withColumns({"bucket": FS.bucket(F.col("name")), "extension": FS.extension(F.col("name"))})


# --- paged answers ---------------------------------------------------------------


def write_title_batches(titles: DataFrame, path: str, size: int = 25) -> None:
    """Distinct titles (title) as JSON lines of `size` titles a batch, which is what a partition asks for. Batches do not depend on the order of rows."""
    numbered = titles.select(F.trim("title").alias("title")).filter("title <> ''").distinct()
    n = max(1, numbered.count() // size)
    dealt = numbered.groupBy(F.pmod(F.xxhash64("title"), F.lit(n)).alias("b")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("titles") - 1) / size).cast("int")), lambda k: F.slice("titles", k * size + 1, size))
    dealt.select(F.explode(chunks).alias("titles")).write.mode("append").json(path)


@dataclass
class _Batch(InputPartition):
    file: str
    line: int


class Answers(DataSource):
    """Answers to the batches below `path`, from `base` by the function that `opener` names (module:function).

    As a batch it asks for all of them; as a stream an offset is a number of batch files, kept in the stream's own log, so that what was committed is not asked for again.
    """

    @classmethod
    def name(cls) -> str:
        return "annolith_answers"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> DataSourceReader:
        return _AnswerReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _AnswerStream(dict(self.options))


class _Asking:
    def __init__(self, options: dict[str, str]):
        self.path, self.base, self.opener = options["path"], options["base"], options["opener"]

    def _batch_files(self) -> list[str]:
        """Batch files by the time they came, then by name: what a stream has seen stays where it is."""
        fs, base = _open(self.path)
        listed = [i for i in fs.get_file_info(afs.FileSelector(base)) if i.type == afs.FileType.File and i.base_name.startswith("part-") and i.size]
        return [i.base_name for i in sorted(listed, key=lambda i: (i.mtime_ns, i.base_name))]

    def _lines(self, file: str) -> list[str]:
        fs, base = _open(self.path)
        with fs.open_input_stream(f"{base}/{file}") as f:
            return [x for x in f.read().decode().split("\n") if x]

    def _batches(self, files: list[str]) -> list[InputPartition]:
        return [_Batch(f, k) for f in files for k in range(len(self._lines(f)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Asks in the task, with its own tries; a task that runs again asks again and gives the same rows."""
        module, _, function = self.opener.partition(":")
        opener = getattr(importlib.import_module(module), function)
        titles = json.loads(self._lines(partition.file)[partition.line])["titles"]
        found: dict[str, str] = {}
        for page in web.pages(self.base, {"titles": "|".join(titles)}, opener):
            for title, answer in page.get("answers", {}).items():
                found[title] = json.dumps(answer, sort_keys=True, ensure_ascii=False)
        for title in titles:
            yield title, found.get(title), f"{partition.file}:{partition.line}"


class _AnswerReader(_Asking, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._batches(self._batch_files())


class _AnswerStream(_Asking, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._batch_files())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._batches(self._batch_files()[start["files"] : end["files"]])

    def commit(self, end: dict) -> None:
        pass


def saved_answers(spark: SparkSession, path: str, base: str, opener: str) -> DataFrame:
    """ANSWERS of all batches below path, a partition a batch."""
    spark.dataSource.register(Answers)
    return spark.read.format(Answers.name()).options(path=path, base=base, opener=opener).load()


def answer_stream(spark: SparkSession, path: str, base: str, opener: str) -> DataFrame:
    """The same as a stream: batches that are added are asked for once they are there."""
    spark.dataSource.register(Answers)
    return spark.readStream.format(Answers.name()).options(path=path, base=base, opener=opener).load()

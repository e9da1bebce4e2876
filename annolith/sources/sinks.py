"""Sinks: ordered delimited files, label files, JSON summaries and text reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V


class UnsafeOutput(Exception):
    """An output place that lies inside what is read."""


def refuse_inside(output: str, *protected: str) -> None:
    """Raises if output is a protected folder or lies in one."""
    clean = lambda p: "/" + "/".join(x for x in p.split("://")[-1].replace("\\", "/").split("/") if x not in ("", "."))
    for folder in protected:
        if clean(output) == clean(folder) or clean(output).startswith(clean(folder) + "/"):
            raise UnsafeOutput(f"{output} lies inside {folder}")


def three_decimals(value: Column) -> Column:
    """Clamped to [0, 1], three decimals, half-even as the binary value stands."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value.cast("double")))
    return F.format_string("%.3f", F.bround(clamped, 3))


CSV = {"lineSep": "\n", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, the path, and the configuration."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place, conf


def joined(spark: SparkSession, parts: list[str | bytes], target: str) -> None:
    """One file of the bytes given and of the part files of the folders named, in order; it gets its name when it is whole.

    Where the file system can concatenate (and all parts are files) it does; elsewhere the bytes pass through in blocks and are never held.
    """
    jvm, (fs, place, conf) = spark.sparkContext._jvm, _files(spark, target)
    if fs.exists(place):
        raise UnsafeOutput(f"{target} exists")
    partial = jvm.org.apache.hadoop.fs.Path(f"{target}.part")
    fs.setWriteChecksum(False)  # a local file system would put a file of its own beside it
    out = fs.create(partial, True)
    fs.setWriteChecksum(True)
    pieces: list = []
    for part in parts:
        if isinstance(part, bytes):
            pieces.append(part)
        else:
            listed = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(part)) if s.getPath().getName().startswith("part-") and s.getLen()]
            pieces += sorted(listed, key=lambda p: int(p.getName().split("-")[1].split(".")[0]))
    while pieces and isinstance(pieces[0], bytes):
        out.write(pieces.pop(0))
    if fs.getScheme() == "hdfs" and pieces and not any(isinstance(p, bytes) for p in pieces):
        out.close()
        _concat(spark, fs, partial, pieces)
    else:
        for p in pieces:
            if isinstance(p, bytes):
                out.write(p)
            else:
                read = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, conf, False)
                read.close()
        out.close()
    if not fs.rename(partial, place):
        raise UnsafeOutput(f"{target} could not be named")


def _concat(spark: SparkSession, fs, target, pieces: list) -> None:
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(pieces))
    for k, p in enumerate(pieces):
        array[k] = p
    fs.concat(target, array)


#: Rows that a task sorts for an ordered file.
RANGE_ROWS = 100_000


def write_ordered(df: DataFrame, path: str, order: list[str], drop: tuple[str, ...] = (), header: bool = False, delimiter: str = ";") -> int:
    """One delimited file in a new folder, sorted; returns the rows written.

    Ranges of the order, of about RANGE_ROWS rows each, are sorted and written by as many tasks as there are ranges, and their files joined.
    The rows returned are counted by the job that writes them.
    """
    spark = df.sparkSession
    fs, place, _ = _files(spark, path)
    if fs.exists(place) and fs.listStatus(place):
        raise UnsafeOutput(f"{path} is not empty")
    counted = Observation()
    if order:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
        # rows that tie are spread over ranges too, so that a key of very many rows is sorted by several tasks
        df = df.withColumn("__spread", F.rand(5)).repartitionByRange(ranges, *order, "__spread").sortWithinPartitions(*order)
    rows = df.drop(*drop, "__spread")
    parts = f"{path}/_parts"
    rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.csv(parts, sep=delimiter, header=False, **CSV)
    head = [(delimiter.join(rows.columns) + "\n").encode()] if header else []
    joined(spark, [*head, parts], f"{path}/part-00000.csv")
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parts), True)
    return counted.get["rows"]


def write_submission(records: DataFrame, path: str, header: bool = False) -> int:
    """image;plate_num;plate_type;confidence in one file, in order of image and ordinal, then of the other columns; returns the rows written."""
    rows = records.select("image", "plate_num", "plate_type", three_decimals(F.col("confidence")).alias("confidence"), "ordinal")
    return write_ordered(rows, path, ["image", "ordinal", "plate_num", "plate_type", "confidence"], ("ordinal",), header)


def write_manifest(rows: DataFrame, path: str) -> int:
    """A split manifest sorted by image."""
    return write_ordered(rows.select(*V.SPLIT_MANIFEST.names).na.fill(""), path, ["image"], header=True)


def write_candidates(rows: DataFrame, path: str) -> int:
    """Candidates in the order of their ids; blank cells for what is missing."""
    return write_ordered(rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in V.CANDIDATE_FIELDS)), path, ["candidate_id", "original_url"], header=True)


def review_rows(items: DataFrame, human: list[str]) -> DataFrame:
    """items with the columns that a person fills in left blank."""
    return items.withColumns({c: F.lit("") for c in human})


def write_review(items: DataFrame, path: str, human: list[str]) -> int:
    """Review rows in one file, in the order of their first column; arrays are joined by commas. Reasons and flags are such columns."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in items.dtypes]
    return write_ordered(review_rows(items.select(*flat), human), path, items.columns[:1], header=True)


def label_lines(boxes: DataFrame, image: str, ordinal: str, line: Column) -> DataFrame:
    """(image, text): one label text for each image, its lines in order; images whose boxes all fall outside get an empty one."""
    each = boxes.select(image, F.struct(F.col(ordinal), line.alias("line")).alias("s"))
    listed = F.filter(F.array_sort(F.collect_list("s")), lambda s: s["line"].isNotNull())
    return each.groupBy(image).agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("text"))


def write_labels(boxes: DataFrame, path: str, image: str, ordinal: str, line: Column, split: str) -> None:
    """Label texts by split: a row an image, partitioned by split, so that any number of tasks write."""
    splits = boxes.select(image, split).distinct()
    label_lines(boxes, image, ordinal, line).join(splits, image).write.mode("errorifexists").partitionBy(split).json(path)


#: Rows of a table that a report on the driver may hold.
REPORT_ROWS = 100_000


def json_report(tables: dict[str, DataFrame], detail: str = "full", per_row: tuple[str, ...] = ("images", "annotations")) -> str:
    """An audit's tables as one JSON text, counts of the per-row tables only in a summary; a table of more than REPORT_ROWS is for json_tables()."""
    out: dict[str, object] = {}
    for name, df in tables.items():
        n = out[f"{name}_count"] = df.count()
        if detail == "full" or name not in per_row:
            if n > REPORT_ROWS:
                raise ValueError(f"{name} has {n} rows; write it with json_tables()")
            out[name] = [json.loads(r) for r in df.toJSON().collect()]
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False)


def json_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines in a folder of its own, written by executors."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def text_report(title: str, counts: DataFrame, findings: DataFrame, most: int = 50) -> str:
    """A report a person reads: counts with their share, then the first findings of each severity."""
    rows = [tuple(r) for r in counts.collect()]
    total = sum(r[-1] for r in rows)
    lines = [title, "=" * len(title), ""]
    lines += [f"{' '.join(str(x) for x in r[:-1]):<40} {r[-1]:>8}  {100 * r[-1] / total if total else 0:5.1f} %" for r in rows]
    for severity in ("error", "warning"):
        own = findings.filter(F.col("severity") == severity)
        shown = own.orderBy(F.coalesce("row", F.lit(0)), "message").limit(most).collect()
        n = own.count()
        lines += ["", f"{severity}s: {n}", *(f"  line {r.row}: {r.message}" if r.row else f"  {r.message}" for r in shown)]
        if n > most:
            lines.append(f"  ... and {n - most} more")
    return "\n".join(lines) + "\n"


def frozen(files: DataFrame) -> dict:
    """The digest of (image, sha256) and the count: what a frozen dataset is known by."""
    from ..functions.hashing import combined_digests

    row = combined_digests(files, [], F.concat_ws(" ", "image", "sha256")).first()
    return {"digest": row.digest if row else hashlib.sha256().hexdigest(), "images": row.n if row else 0}


def check_frozen(files: DataFrame, expected: dict) -> list[str]:
    """What differs from a frozen record."""
    now = frozen(files)
    return [f"{k}: frozen {expected.get(k)!r}, now {v!r}" for k, v in now.items() if expected.get(k) != v]

"""Delimited and JSON sources with declared schemas. Cells stay strings; what cannot be parsed becomes a finding later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V
from ..functions import text as X


class SourceError(Exception):
    """A source that cannot be read as declared."""


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files, lines from 1. A file's lines are numbered in its own row, so files spread over tasks."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n"), "\n")
    return whole.select("path", F.posexplode(lines).alias("line", "value")).withColumn("line", F.col("line") + 1)


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files of any size, lines from 1: a block's lines are read one by one and numbered on from those of the blocks before it.

    Ids rise by one within a block, so that of the text nothing is shuffled; a row a block is broadcast.
    """
    block = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"))
    rows = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("i"), "value")
    before = W.partitionBy("path").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "b").agg(F.min("i").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rows.join(F.broadcast(blocks.select("path", "b", "first", "before")), ["path", "b"]).withColumn("line", F.col("before") + F.col("i") - F.col("first") + 1)
    return numbered.select("path", F.col("line").cast("int").alias("line"), F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def cells(line: Column, delimiter: str) -> Column:
    """The cells of one line, quotes respected: a quoted cell may hold the delimiter, and "" stands for a quote."""
    d = "\\" + delimiter
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
    return F.transform(found, lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows: the declared columns as strings, `line` (header 1) and `cell_count`; blank rows go, short ones are padded."""
    if not exists(spark, path):
        raise SourceError(f"{path} does not exist")
    lines = block_lines(spark, path).withColumn("cells", cells(F.col("value"), ";"))
    head = lines.filter("line = 1 and trim(value) <> ''").select("cells").first()
    if head is None:
        raise SourceError(f"{path} is empty (no header row)")
    header = [c.strip() for c in head.cells]
    rows = lines.filter((F.col("line") > 1) & F.exists("cells", lambda c: X.stripped(c) != ""))
    named = [F.coalesce(F.get("cells", F.lit(header.index(c))), F.lit("")).alias(c) for c in dict.fromkeys(header)]
    return rows.select(*named, "line", F.size("cells").alias("cell_count"))


def read_header(spark: SparkSession, path: str) -> list[str]:
    first = numbered_lines(spark, path).filter("line = 1").select(cells(F.col("value"), ";").alias("c")).first()
    return [c.strip() for c in first.c] if first else []


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ";") -> DataFrame:
    """Strings by declared schema; an absent file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    read = spark.read.csv(path, sep=delimiter, header=True, enforceSchema=False, quote='"', escape='"')
    return read.select(*((F.col(f.name) if f.name in read.columns else F.lit(None).cast("string").alias(f.name)) for f in schema.fields))


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an image; an unknown split or an empty group is an error when it is read."""
    rows = read_delimited(spark, path, V.SPLIT_MANIFEST)
    trimmed = rows.select(*(X.stripped(F.col(c)).alias(c) for c in rows.columns)).filter("image <> ''")
    bad = F.when(~F.col("split").isin(*V.REAL_SPLITS), F.raise_error(F.concat(F.lit("unknown split "), "split"))).when(F.col("group") == "", F.raise_error(F.concat(F.lit("empty group for "), "image")))
    return trimmed.withColumn("split", F.coalesce(bad.cast("string"), F.col("split")))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, V.CANDIDATE_MANIFEST)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(image, group), backslashes turned, blanks trimmed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("image", "group")])
    return read_delimited(spark, path, schema).select(X.forward_slashes(F.col("image")).alias("image"), X.stripped(F.col("group")).alias("group")).filter("image <> ''")


GENERATION = "image string, difficulty string, geometry struct<min_char_height_px: double>, hidden_positions array<int>"


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """(image, difficulty, char_height, hidden): four fields of the generator's records, the rest is never parsed."""
    if not exists(spark, path):
        return spark.createDataFrame([], "image string, difficulty string, char_height double, hidden int")
    return spark.read.schema(GENERATION).json(path).select("image", F.coalesce("difficulty", F.lit("?")).alias("difficulty"), F.col("geometry.min_char_height_px").alias("char_height"), F.coalesce(F.size("hidden_positions"), F.lit(0)).alias("hidden"))


def read_difficulty(spark: SparkSession, path: str) -> DataFrame:
    """(image, difficulty) of a synthetic manifest; an image without one has `?`."""
    rows = read_delimited(spark, path, V.SYNTHETIC_MANIFEST).filter("image <> ''")
    return rows.select("image", F.when(X.text_or_empty(F.col("difficulty")) == "", "?").otherwise(F.col("difficulty")).alias("difficulty"))


def sheet_inputs(spark: SparkSession, meta: str, records: str) -> DataFrame:
    """Annotation rows with difficulty, character height and hidden characters of the generator's records, for contact sheets."""
    rows = read_meta(spark, meta).withColumn("image", X.forward_slashes(F.col("image")))
    return rows.join(read_generation(spark, records), "image", "left")


def samples(meta: DataFrame, synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """Typed annotation rows with `split` as population:split, the real manifest before the synthetic one, else ?:?."""
    from ..operators.rules import typed
    from ..operators.splits import union_lookup

    named = union_lookup(real.select("image", F.concat(F.lit("real:"), "split").alias("split")), synthetic.select("image", F.concat(F.lit("synthetic:"), "split").alias("split")), "image")
    return typed(meta).join(named.withColumnRenamed("image", "image_path"), "image_path", "left").withColumn("split", F.coalesce("split", F.lit("?:?")))


def read_source_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: the declared fields as strings and `problems`."""
    from ..operators.rules import record_problems

    schema = T.StructType([T.StructField(c, T.StringType()) for c in V.RECORD_FIELDS])
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parsed = whole.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    rows = parsed.select("path", "keys", *(F.col(f"r.{c}").alias(c) for c in V.RECORD_FIELDS))
    missing = F.transform(F.filter(F.array(*(F.lit(c) for c in V.RECORD_FIELDS)), lambda c: ~F.array_contains("keys", c)), lambda c: F.concat(F.lit("missing field '"), c, F.lit("'")))
    problems = F.when(F.col("keys").isNull(), F.array(F.lit("source record is not a JSON object"))).otherwise(F.concat(missing, record_problems(list(V.RECORD_FIELDS))))
    return rows.withColumn("problems", problems).drop("keys")


PREDICTIONS = (
    "predictions array<struct<image: string, detections: array<struct<bbox: array<double>, confidence: double, plate_type: string, plate_num: string, "
    "type_confidence: double, raw_text: string, char_scores: array<double>, format_valid: boolean, final_confidence: double, two_line: boolean, below_operating: boolean>>>>, operating_confidence double"
)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(image, ordinal, detection fields) of a predictions file, wrapped in an object or a bare list; the last entry of an image counts."""
    from ..operators.dedup import keep_last

    whole = spark.read.text(path, wholetext=True).select(F.btrim("value").alias("value"))
    wrapped = F.when(F.startswith("value", F.lit("[")), F.concat(F.lit('{"predictions":'), "value", F.lit("}"))).otherwise(F.col("value"))
    images = whole.select(F.from_json(wrapped, PREDICTIONS).alias("r")).select(F.posexplode("r.predictions").alias("place", "p")).select("place", "p.image", "p.detections")
    return keep_last(images, ["image"], "place").select("image", F.posexplode("detections").alias("ordinal", "d")).select("image", "ordinal", "d.*")


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one delimited file, lines from 1 as they stand in it: those of a block are numbered in it, and the blocks before are added."""
    from pyspark.sql import Window as W

    rows = spark.read.text(path).select(F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("text"))
    within = rows.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("i")))
    # as many rows as the file has blocks
    before = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before), "b").select((F.col("before") + F.col("r")).alias("line"), "text")


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """Live licence metadata from saved API answers: (title, url, descriptionurl, width, height, size, mime, sha1, license, ...); markup goes, missing titles are absent."""
    field = "struct<value: string>"
    meta = ", ".join(f"{n}: {field}" for n in ("LicenseShortName", "LicenseUrl", "Artist", "Credit", "AttributionRequired", "Restrictions"))
    info = f"struct<url: string, descriptionurl: string, width: long, height: long, size: long, mime: string, sha1: string, extmetadata: struct<{meta}>>"
    schema = f"query struct<pages: map<string, struct<title: string, missing: string, imageinfo: array<{info}>>>>"
    whole = spark.read.text(path, wholetext=True)
    pages = whole.select(F.explode(F.map_values(F.from_json("value", schema)["query"]["pages"])).alias("p")).filter("p.missing is null and size(p.imageinfo) > 0")
    i = F.get("p.imageinfo", F.lit(0))
    said = lambda n: X.strip_markup(i["extmetadata"][n]["value"])
    return pages.select(
        F.col("p.title").alias("title"), *(i[c].alias(c) for c in ("url", "descriptionurl", "width", "height", "size", "mime", "sha1")),
        said("LicenseShortName").alias("license"), said("LicenseUrl").alias("license_url"), said("Artist").alias("artist"),
        said("Credit").alias("credit"), said("AttributionRequired").alias("attribution_required"), said("Restrictions").alias("restrictions"),
    )


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """Rows of a manifest, the last line of a key only."""
    by = W.partitionBy(key).orderBy(F.col("line").desc())
    return df.withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r")

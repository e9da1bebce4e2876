"""The prediction job as a plan: files to images, injectable stages over Arrow batches, then confidence, filter and records as columns.

A stage is a picklable function from image bytes to a list of readings; sessions are made once for each worker, and an image that
fails becomes a row with an error and never ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import validate_plate
from ..operators.metrics import confidence
from ..session import staged
from ..sources.sinks import write_submission

READINGS = (
    "name string, ordinal int, x double, y double, w double, h double, detection double, plate_type string, type_confidence double, "
    "plate_num string, text_confidence double, error string"
)
ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in READINGS.split(", ")])


def placeholder() -> Callable[[bytes], list[dict]]:
    """A stage that finds nothing."""
    return lambda data: []


def read_plates(images: DataFrame, make_stage: Callable[[], Callable[[bytes], list[dict]]] = placeholder) -> DataFrame:
    """(name, content) to one row a reading, or a row with an error, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stage = make_stage()
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"name": name, "ordinal": k, **r} for k, r in enumerate(stage(bytes(data)))]
                except Exception as error:  # noqa: BLE001 - isolated to its image
                    rows.append({"name": name, "ordinal": -1, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return images.select("name", "content").mapInArrow(run, READINGS)


def records(readings: DataFrame, least: float = 0.0) -> DataFrame:
    """(image, ordinal, plate_num, plate_type, confidence): readings with text at or above the least confidence."""
    checked = readings.filter("error is null and plate_num <> ''").withColumn("v", validate_plate(F.col("plate_num"), F.col("plate_type")))
    scored = checked.withColumn("confidence", confidence(F.col("detection"), F.col("type_confidence"), F.col("text_confidence"), F.col("v.is_valid")))
    return scored.filter(F.col("confidence") >= least).select(F.col("name").alias("image"), "ordinal", "plate_num", "plate_type", "confidence")


def run_counters(readings: DataFrame, written: DataFrame) -> DataFrame:
    """One row: images that failed, readings and records."""
    return readings.agg(F.sum(F.col("error").isNotNull().cast("long")).alias("failed"), F.sum(F.col("error").isNull().cast("long")).alias("readings")).join(written.agg(F.count("*").alias("records")))


def predicted_to(images: DataFrame, make_stage: Callable[[], Callable[[bytes], list[dict]]], path: str, least: float = 0.0) -> dict[str, int]:
    """Reads plates from images (name, content) and writes one submission file; returns images failed, readings, records and rows written.

    The counters are observed in the job that runs the model, which runs once: its records are staged before their order is sampled.
    """
    read, kept = Observation(), Observation()
    readings = read_plates(images, make_stage).observe(read, F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull()).alias("readings"))
    found = staged(records(readings, least).observe(kept, F.count(F.lit(1)).alias("records")), "records")
    return {**read.get, **kept.get, "written": write_submission(found, path)}


def onnx_stage(model: bytes, encode: Callable[[bytes], dict], decode: Callable[[list, dict], list[dict]]) -> Callable[[], Callable[[bytes], list[dict]]]:
    """make_stage for read_plates(): a session of the model, made once for each worker's task; encode makes its inputs of an image, decode readings of its outputs.

    The model travels as bytes, so executors need no file of their own.
    """

    def make() -> Callable[[bytes], list[dict]]:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])

        def stage(data: bytes) -> list[dict]:
            inputs = encode(data)
            return decode(session.run(None, inputs), inputs)

        return stage

    return make


def timed(make_stage: Callable[[], Callable[[bytes], list[dict]]], name: str) -> Callable[[], Callable[[bytes], list[dict]]]:
    """make_stage that gives one reading an image, whose `detection` is the milliseconds that the stage took; for stage_times()."""

    def make() -> Callable[[bytes], list[dict]]:
        import time

        stage = make_stage()

        def run(data: bytes) -> list[dict]:
            began = time.perf_counter()
            stage(data)
            return [{"plate_type": name, "detection": 1000 * (time.perf_counter() - began)}]

        return run

    return make


def stage_times(images: DataFrame, stages: dict[str, Callable[[], Callable[[bytes], list[dict]]]]) -> DataFrame:
    """(name, stage, ms) of every image and stage that did not fail, for aggregates.run_stats()."""
    out = None
    for stage, make in stages.items():
        took = read_plates(images, timed(make, stage)).filter("error is null").select("name", F.lit(stage).alias("stage"), F.col("detection").alias("ms"))
        out = took if out is None else out.unionByName(took)
    return out


def predictions(readings: DataFrame, operating: float) -> DataFrame:
    """(image, detections): the readings of an image in order, as the predictions source reads them; images without readings are absent."""
    checked = readings.filter("error is null").withColumn("v", validate_plate(F.col("plate_num"), F.col("plate_type")))
    detection = F.struct(
        F.col("ordinal").alias("ordinal"), F.array("x", "y", "w", "h").alias("bbox"), F.col("detection").alias("confidence"), "plate_type", F.coalesce("plate_num", F.lit("")).alias("plate_num"),
        "type_confidence", F.col("v.is_valid").alias("format_valid"), confidence(F.col("detection"), F.col("type_confidence"), F.col("text_confidence"), F.col("v.is_valid")).alias("final_confidence"),
        (F.col("detection") < operating).alias("below_operating"),
    )
    listed = checked.groupBy(F.col("name").alias("image")).agg(F.array_sort(F.collect_list(detection)).alias("d"))
    return listed.select("image", F.transform("d", lambda x: x.dropFields("ordinal")).alias("detections"))


def write_predictions(readings: DataFrame, path: str, operating: float) -> None:
    """Predictions as 256 JSON texts at most, with the operating confidence in each."""
    found = predictions(readings, operating)
    parts = found.groupBy(F.pmod(F.xxhash64("image"), F.lit(256)).alias("p")).agg(F.collect_list(F.struct("image", "detections")).alias("predictions"))
    parts.select("p", F.to_json(F.struct("predictions", F.lit(operating).alias("operating_confidence"))).alias("value")).write.mode("errorifexists").partitionBy("p").text(path)

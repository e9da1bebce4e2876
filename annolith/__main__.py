"""Commands: `queries` lists the catalogue, `run` shows or writes a query's rows, `score` holds predictions against annotations, `predict` writes a submission."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue
from .functions.geometry import box
from .operators import matching as M
from .operators import metrics as T
from .operators.rules import typed
from .plans.inference import predicted_to
from .session import local_session
from .sources import tables
from .sources.files import images, listing


def scored(spark: SparkSession, meta: str, predictions: str, confidence: float) -> dict[str, DataFrame]:
    """The detection report, the operating point and the outcomes of predictions against annotation rows."""
    rows = typed(tables.read_meta(spark, meta)).filter("bbox is not null and not is_background")
    at = lambda c, i: F.get(c, F.lit(i))
    shape = lambda c: box(*(at(c, i) for i in range(4)))
    plates = rows.select(F.col("image_path").alias("image"), "line", shape(F.col("bbox")).alias("b"), F.col("plate").alias("plate_num"), F.col("kind").alias("plate_type"))
    truth = M.grouped_boxes(plates, "image", F.col("line"), F.col("b"), name="truth", more=("plate_num", "plate_type"))
    found = tables.read_predictions(spark, predictions).select("image", "ordinal", shape(F.col("bbox")).alias("b"), "confidence", F.coalesce("plate_num", F.lit("")).alias("plate_num"), "plate_type")
    read = M.grouped_boxes(found, "image", F.col("ordinal"), F.col("b"), F.col("confidence"), "predictions", ("plate_num", "plate_type"))
    return {"ladder": T.detection_report(truth, read), "operating": T.operating_point(truth, read, confidence), "outcomes": T.end_to_end(truth, read, confidence)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="annolith")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(catalogue.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out")
    score = commands.add_parser("score")
    score.add_argument("meta")
    score.add_argument("predictions")
    score.add_argument("--confidence", type=float, default=0.5)
    predict = commands.add_parser("predict")
    predict.add_argument("images")
    predict.add_argument("out")
    predict.add_argument("--stage", default="annolith.plans.inference:placeholder", help="module:function that makes a stage")
    predict.add_argument("--least", type=float, default=0.0)
    given = parser.parse_args(argv)
    if given.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.getActiveSession() or local_session("*")
    if given.command == "predict":
        module, _, name = given.stage.partition(":")
        files = images(listing(spark, given.images)).select("name", "content")
        print(predicted_to(files, getattr(importlib.import_module(module), name), given.out, given.least))
        return 0
    if given.command == "run":
        found = catalogue.QUERIES[given.query](spark, given.folder)
        found.write.mode("errorifexists").parquet(given.out) if given.out else found.show(truncate=False)
        return 0
    for name, df in scored(spark, given.meta, given.predictions, given.confidence).items():
        print(name)
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

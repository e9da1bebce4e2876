"""Steps whose figures grew faster than their input, and ties that the SQL leaves to the order of the rows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith import catalogue
from annolith.functions import geometry as G
from annolith.operators import dedup as D
from annolith.operators import matching as M
from annolith.operators import metrics as T
from annolith.operators import settings
from annolith.sources import sinks
from annolith.sources import tables as TB
from annolith.streaming import manifest


def test_largest_takes_the_first_of_equal_rows(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"COPY (SELECT * REPLACE (floor(l_extendedprice / 20000)::double AS l_extendedprice) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    expected = con.execute(catalogue.ORACLES["largest_per_group"]).fetchall()
    assert sorted(map(tuple, catalogue.QUERIES["largest_per_group"](spark, str(tmp_path)).collect())) == sorted(expected)


def test_a_manifest_calls_its_state_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "BUCKETS", 4)
    items = spark.range(300).selectExpr("cast(id AS string) AS image", "cast(id % 7 AS string) AS `group`", "'s' AS source")
    items.write.parquet(f"{tmp_path}/in")
    frozen = items.limit(50).selectExpr("image", "`group`", "'val' AS split")
    stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
    manifest.grow_manifest_files(stream, f"{tmp_path}/out", f"{tmp_path}/log", 3, frozen=frozen)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 250
    state = spark.read.format("statestore").option("stateVarName", "held").option("operatorId", 0).load(f"{tmp_path}/log")
    assert 1 <= state.count() <= 4


def test_keypoint_cells_are_no_formatted_strings(spark):
    values = [0.0, 0.1234565, 1e-7, 5e-7, 33.3333335, 99.9999999, 100.0, 150.0]
    quad = F.array(*(F.lit(v) for v in values))
    line = G.keypoint_line(G.box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(1 / 3)), quad, F.lit(100.0), F.lit(100.0))
    df = spark.range(1).select(line.alias("l"), G.keypoint_line(G.box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(1.0)), F.lit(None).cast("array<double>"), F.lit(100.0), F.lit(100.0)).alias("b"))
    row = df.first()
    assert row.l == "0 0.250000 0.201667 0.300000 0.003333 0.000000 0.001235 2 0.000000 0.000000 2 0.333333 1.000000 2 1.000000 1.000000 2"
    assert row.b == "0 0.250000 0.205000 0.300000 0.010000"
    rows = spark.range(1).select(G.keypoint_line(G.box(F.col("id"), F.col("id"), F.col("id"), F.col("id")), F.array(*(F.col("id").cast("double") for _ in range(8))), F.lit(100.0), F.lit(100.0)))
    assert "format_string" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_and_stripes_give_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(D, "BLOCK_ROWS", 20)
    monkeypatch.setattr(D, "STRIPE_ROWS", 3)
    vectors = np.random.default_rng(4).standard_normal((90, 6)).astype("f4" if kind == "float" else "f8")
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], f"id int, v array<{kind}>")
    pairs = D.correlated_pairs(df, "id", "v", 0.6)
    exact = np.corrcoef(vectors.astype(float))
    assert {(r["first"], r["second"]) for r in pairs.collect()} == {(a, b) for a in range(90) for b in range(a + 1, 90) if exact[a, b] >= 0.6}
    # vectors are shuffled as they come
    assert kind == "double" or "as array<double>" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_a_meta_file_is_read_in_blocks(spark, tmp_path):
    rows = [f"images/{k}.jpg;A{k}" for k in range(4000)]
    for name in "ab":
        (tmp_path / f"{name}.csv").write_bytes(("\ufeffimage;plate_num\r\n" + "\r\n".join([*rows[:10], " ; ", *rows[10:]])).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = TB.read_meta(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 10
        found = sorted((r.line, r.image, r.plate_num, r.cell_count) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted((k + 2 + (k >= 10), f"images/{k}.jpg", f"A{k}", 2) for k in range(4000) for _ in "ab")


def test_an_ordered_file_has_as_many_ranges_as_its_rows_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "RANGE_ROWS", 100)
    lengths = []
    joined = sinks.joined
    monkeypatch.setattr(sinks, "joined", lambda s, parts, target: (lengths.extend(len(p.read_text().split()) for p in (tmp_path / "out/_parts").glob("part-*")), joined(s, parts, target)))
    # two thirds of all rows share a key
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("1").alias("image"))
    assert sinks.write_ordered(df, f"{tmp_path}/out", ["image"]) == 3000 and len(lengths) >= 25 and max(lengths) < 400
    assert (tmp_path / "out/part-00000.csv").read_text().split() == sorted(r.image for r in df.collect())


def test_settings_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") % 100).alias("config"), F.concat(F.lit("n"), F.floor(F.col("id") / 100)).alias("name"), F.lit("1").alias("value"))
    rules = settings.rule_table(spark, [settings.Rule("n1", "number"), settings.Rule("gone", "number")])
    monkeypatch.setattr(settings, "TASK_ROWS", 30)
    found = settings.setting_findings(df, rules)
    assert "hashpartitioning(config" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 30), REPARTITION_BY_NUM" in plan
    assert found.filter("finding = 'is missing'").count() == 100 and found.filter("finding = 'is unknown'").count() == 800 and found.count() == 900


def crowds(spark, images, boxes):
    """Images of boxes of every size, empty ones and ties among them; some have no truth or no prediction."""
    draw = random.Random(8)
    rows = [(i, k, draw.uniform(-50, 300), draw.uniform(-50, 300), draw.choice([0.0, 5.0, 30.0, 30.0, 200.0]), draw.choice([5.0, 20.0, 20.0, 300.0]), draw.randrange(5) / 5) for i in range(images) for k in range(draw.randrange(boxes))]
    df = spark.createDataFrame(rows, "image int, o int, x double, y double, w double, h double, s double")
    truth = M.grouped_boxes(df.filter("image % 5 > 0"), "image", F.col("o"), F.struct("x", "y", "w", "h"), name="truth")
    moved = F.struct((F.col("x") + F.col("o") % 3).alias("x"), "y", "w", "h")
    return truth, M.grouped_boxes(df.filter("image % 7 > 0"), "image", F.col("o"), moved, F.col("s"), "predictions")


@pytest.mark.parametrize("crowd", [1, 1 << 14])
def test_crowds_are_suppressed_in_one_pass(spark, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    _, boxes = crowds(spark, 60, 40)
    kept = M.suppressed_crowds(boxes, "image", "predictions", 0.2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    fold = boxes.select("image", M.suppressed(F.col("predictions"), 0.2).alias("k"))
    assert {r.image: [b.ordinal for b in r.kept] for r in kept.collect()} == {r.image: [b.ordinal for b in r.k] for r in fold.collect()}


@pytest.mark.parametrize("crowd", [1, 1 << 14])
def test_postprocessed_as_the_fold(spark, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    _, boxes = crowds(spark, 60, 40)
    how = (250.0, F.lit(2.0), F.lit(0.5), 0.1, 0.3, 12, 5)
    got = M.postprocessed(boxes, "image", "predictions", *how)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.image: r.kept for r in got.collect()} == {r.image: r.k for r in boxes.select("image", M.postprocess(F.col("predictions"), *how).alias("k")).collect()}


@pytest.mark.parametrize("crowd", [1, 1 << 14])
def test_a_ladder_is_ranked_once(spark, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    truth, predictions = crowds(spark, 40, 12)
    ladder = (0.3, 0.6, 0.9)
    got = {r.threshold: (round(r.ap, 12), r.n_truth) for r in T.detection_report(truth, predictions, ladder=ladder).collect()}
    n = truth.agg(F.sum(F.size("truth"))).first()[0]
    for th in ladder:
        listed = M.scored_list(M.matched_images(truth, predictions, "image", th), "image").withColumn("all", F.lit(1))
        ap = T.average_precision(listed, F.max(F.lit(n)), ["all"], "score", "is_tp", ["image", "place"]).first().ap
        assert got.pop(th) == (round(ap, 12), n) and ap > 0
    assert not got
    assert T.detection_report(truth, predictions.limit(0), ladder=ladder).count() == 0


@pytest.mark.parametrize("name", ["greedy_match", "operating_point", "end_to_end_outcomes", "end_to_end_rate"])
def test_images_are_grouped_once(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "SortMergeJoin" not in plan

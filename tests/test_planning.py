"""Permutations, identities, plans, staged-source audits, keyed manifests, crowds and settings."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from annolith import vocab as V
from annolith.operators import intake, planning, settings
from annolith.operators import matching as M
from annolith.streaming import manifest


@pytest.mark.parametrize("size", [1, 2, 3, 7, 255, 1000, 99_991])
def test_permutations_are_bijections(spark, size):
    got = [r[0] for r in spark.range(size).select(planning.permuted(F.col("id"), size, 5)).collect()]
    assert sorted(got) == list(range(size))
    assert size < 100 or got != sorted(got)


def test_a_million_identities_are_distinct_on_any_partitioning(spark):
    kind = F.when(F.col("id") % 2 == 0, "type1").otherwise("type1a")
    drawn = lambda parts: spark.range(0, 1_000_000, 1, parts).select("id", planning.identity(F.col("id"), kind, 7).alias("p"))
    n, distinct, long = drawn(4).agg(F.count("*"), F.count_distinct("p"), F.count_if(F.length("p") == 9)).first()
    assert (n, distinct, long) == (1_000_000, 1_000_000, 350_000)
    assert drawn(3).join(drawn(7).withColumnRenamed("p", "q"), "id").filter("p <> q").isEmpty()
    short = spark.range(300_000).select(planning.identity(F.col("id"), F.lit("type1b"), 7, repeats=3).alias("p")).groupBy("p").count()
    assert short.agg(F.count("*"), F.min("count"), F.max("count")).first() == (100_000, 3, 3)
    pattern = {"type1": r"^[ABCEHKMOPTXY]\d{3}[ABCEHKMOPTXY]{2}(\d\d|[127]\d\d)$", "type1b": r"^[ABCEHKMOPTXY]{2}\d{5}$"}
    assert drawn(4).filter(~F.col("p").rlike(pattern["type1"]) | F.col("p").rlike("^.000|[^0-9]00$")).isEmpty() and short.filter(~F.col("p").rlike(pattern["type1b"])).isEmpty()


def test_a_space_that_is_used_up_is_an_error(spark):
    a, b = planning.SPACES["type1b", 2]
    last = lambda k: spark.range(1).select(planning.identity(F.lit(k), F.lit("type1b"), 1)).first()[0]
    assert len(last(a * b - 1)) == 7
    with pytest.raises(Exception, match="no unused plate left"):
        last(a * b)


def test_plans_meet_quotas_and_budgets(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = planning.plan(rows.repartition(5), "key", 11).collect()
    kinds = collections.Counter(r.plate_type for r in got)
    assert kinds == {"type1": 600, "type1a": 1200, "type1b": 1200} and len({r.plate_num for r in got}) == 3000
    levels = collections.Counter((r.plate_type, r.difficulty) for r in got)
    assert levels["type1a", "easy"] == 420 and levels["type1a", "medium"] == 540 and levels["type1a", "hard"] == 240
    order = list(V.EFFECT_SEVERITY)
    for r in got:
        level = V.EFFECT_LEVELS[r.difficulty]
        assert len(r.effects) <= level["most"] and r.severity == sum(V.EFFECT_SEVERITY[e] for e in r.effects) / 100 <= level["budget"] / 100
        assert r.effects == sorted(r.effects, key=order.index) and not any(a in r.effects and b in r.effects for a, b in V.EXCLUSIVE_EFFECTS)
    share = sum("dirt" in r.effects for r in got if r.difficulty == "hard") / 600
    assert 0.1 < share < 0.45
    again = planning.plan(rows.repartition(2), "key", 11).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert planning.plan(rows.limit(0), "key", 11).count() == 0


def test_the_sieve_stands_before_the_exchange(spark):
    staged = spark.range(50).select(F.col("id").alias("image"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    dataset = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("image"), F.sha2((F.col("id") + 25).cast("string"), 256).alias("sha256"))
    sieve, n_words = intake.hash_sieve(staged)
    passed = intake.sieved(dataset, sieve, n_words)
    assert 25 <= passed.count() < 30_000
    plan = passed.groupBy("sha256").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(sha256") < plan.index("BroadcastHashJoin")  # the tree is printed from its root
    known = intake.content_findings(staged, dataset).filter(F.col("check") == "already_in_dataset")
    assert {(r.image, r.detail) for r in known.collect()} == {(k, str(k - 25)) for k in range(25, 50)}
    assert intake.content_findings(staged.limit(0), dataset).count() == 0


def test_a_keyed_manifest_restarts_where_it_ended(spark, tmp_path):
    place = {k: str(tmp_path / k) for k in ("in", "out", "log")}
    frozen = spark.createDataFrame([("old", "g1", "holdout"), ("old2", "g2", "val")], "image string, `group` string, split string")

    def run(rows, seed):
        spark.createDataFrame(rows, "image string, `group` string, source string").coalesce(1).write.mode("append").parquet(place["in"])
        stream = spark.readStream.schema("image string, `group` string, source string").parquet(place["in"])
        manifest.grow_manifest_files(stream, place["out"], place["log"], seed, frozen=frozen, assigned_on="d")
        return {(r.image, r.group, r.wanted): (r.split, r.conflict) for r in spark.read.parquet(place["out"]).collect()}

    first = run([("a", "g1", "s"), ("b", "g3", "s"), ("b", "g3", "s"), ("old", "g1", "s"), (None, "g2", None)], 1)
    assert set(first) == {("a", "g1", "g1"), ("b", "g3", "g3"), ("", "g2", "g2")} and first["a", "g1", "g1"] == ("holdout", False) and first["", "g2", "g2"] == ("val", False)
    # another seed: a group keeps the split it was given; a known image gives nothing, or a conflict in another group
    second = run([("b", "g3", "s"), ("c", "g3", "s"), ("a", "g9", "s"), ("old2", "g1", "s")], 99)
    assert {k: v for k, v in second.items() if k in first} == first
    assert {k: v for k, v in second.items() if k not in first} == {("c", "g3", "g3"): first["b", "g3", "g3"], ("a", "g1", "g9"): ("holdout", True), ("old2", "g2", "g1"): ("val", True)}
    assert spark.read.parquet(place["out"]).count() == len(second)


def test_crowded_images(spark, monkeypatch):
    """By grid cells as by all pairs, boxes of every size, empty ones and ties among them."""
    draw = random.Random(6)
    rows = [(i, k, draw.uniform(-50, 300), draw.uniform(-50, 300), draw.choice([0.0, 5.0, 30.0, 30.0, 200.0]), draw.choice([5.0, 20.0, 20.0, 300.0]), draw.randrange(5) / 5) for i in range(6) for k in range(40)]
    df = spark.createDataFrame(rows, "image int, o int, x double, y double, w double, h double, s double")
    boxes = M.grouped_boxes(df, "image", F.col("o"), F.struct("x", "y", "w", "h"), F.col("s"), "boxes").withColumn("other", F.col("boxes"))

    def found():
        pairs = {(r.image, r.l.ordinal, r.r.ordinal, round(r.overlap, 9)) for r in M.close_pairs(boxes, "image", "boxes", "other", 0.2).collect()}
        return pairs, {r.image: [b.ordinal for b in r.kept] for r in M.suppressed_crowds(boxes, "image", "boxes", 0.2).collect()}

    plain = found()
    monkeypatch.setattr(M, "CROWD", 1)
    assert found() == plain and len(plain[0]) > 190
    assert plain[1] == {r.image: [b.ordinal for b in r.k] for r in boxes.select("image", M.suppressed(F.col("boxes"), 0.2).alias("k")).collect()}


def test_settings_as_rows(spark):
    rules = settings.generator_rules()
    good = {r.name: {"choice": '"stroke"', "pair": f"[{r.low}, {r.low}]", "weight": "1"}.get(r.kind, str(r.low if r.kind == "number" else int(r.low or 0))) for r in rules}
    bad = good | {"seed": "-1", "count": "true", "font": None, "difficulties.easy.gamma": "[1, 9]", "difficulties.hard.jpeg_quality": "[90, 10]", "nonsense": "1"}
    bad.pop("supersample")
    rows = [("good", k, v) for k, v in good.items()] + [("bad", k, v) for k, v in bad.items()] + [("bad", "seed", "-1")]
    df = spark.createDataFrame(rows, "config string, name string, value string")
    got = {(r.config, r.name, r.finding) for r in settings.setting_findings(df, settings.rule_table(spark, rules)).collect()}
    assert got == {
        ("bad", "seed", "is outside its bounds"), ("bad", "seed", "is given more than once"), ("bad", "count", "is no number"), ("bad", "font", "has no value"), ("bad", "difficulties.easy.gamma", "is outside its bounds"),
        ("bad", "difficulties.hard.jpeg_quality", "is out of order"), ("bad", "nonsense", "is unknown"), ("bad", "supersample", "is missing"),
    }


def test_placements(spark):
    """Corners as the matrix turns them; every plate inside its image, scaled only where it has to be."""
    import numpy as np

    from annolith.functions import projective as J

    cases = [(520.0, 112.0, 30.0, -20.0, 10.0, 0.4, 5.0), (290.0, 170.0, -45.0, 22.0, -12.0, 0.2, 4.0), (520.0, 112.0, 0.0, 0.0, 0.0, 0.5, 9.0), (520.0, 112.0, 89.0, 0.0, 0.0, 0.5, 0.4)]
    names = ["width", "height", "yaw", "pitch", "roll", "px_per_mm", "distance_ratio"]
    df = spark.createDataFrame(cases, ", ".join(f"{n} double" for n in names)).withColumn("q", J.seen_corners(*map(F.col, names)))
    for r in df.collect()[:3]:
        flat = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * (r.width / 2, r.height / 2)
        expected = r.px_per_mm * J.projected(flat, J.rotation(r.yaw, r.pitch, r.roll), r.distance_ratio * r.width)
        assert r.q == pytest.approx(expected.ravel().tolist(), abs=1e-9)
    assert df.collect()[3].q is None
    plan = planning.plan(spark.range(2000).select(F.col("id").alias("key")), "key", 3)
    rows = planning.placements(plan).collect()
    assert len({(r.width, r.height) for r in rows}) == 4
    for r in rows:
        xs, ys = r.quad[::2], r.quad[1::2]
        assert min(xs) >= 4 - 1e-6 and max(xs) <= r.width - 4 + 1e-6 and min(ys) >= 4 - 1e-6 and max(ys) <= r.height - 4 + 1e-6 and 0 < r.scale <= 1
    one = lambda *a: spark.range(1).select(*a).first()
    quad = F.array(*(F.lit(float(v)) for v in (-50, -20, 50, -20, 50, 20, -50, 20)))
    lit = lambda v: F.lit(float(v))
    assert one(J.fitting_scale(quad, lit(60), lit(100), 5.0), J.fitting_scale(quad, lit(8), lit(100), 5.0)) == (0.5, None)
    low, none = one(J.placed_quad(quad, lit(200), lit(100), lit(0), lit(0), 0.0, lit(60)), J.placed_quad(quad, lit(90), lit(100), lit(0), lit(0), 0.0))
    assert low == [0.0, 40.0, 100.0, 40.0, 100.0, 80.0, 0.0, 80.0] and none is None

"""Settings as rows: every rule is a row too, and what breaks one is a finding, as it is for annotations.

A setting is (config, name, value), the value as JSON writes it. A rule names a setting, or a family of them with a * for one part of
the name, its kind and its bounds. Any number of configurations is checked in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


@dataclass(frozen=True)
class Rule:
    """kind: number, whole, pair (two numbers in order), weight (of a family whose sum is above 0) or choice."""

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    #: The bound itself is not allowed.
    below: bool = False
    choices: tuple[str, ...] = ()
    required: bool = True


LEVELS = tuple(V.LEVEL_WEIGHTS)


def _level_rules() -> list[Rule]:
    return [
        *(Rule(f"difficulties.*.{name}", kind, low, high, below) for name, (kind, low, high, below) in V.LEVEL_SETTINGS.items()),
        *(Rule(f"difficulties.*.effect_probability.{effect}", "number", 0.0, 1.0) for effect in V.EFFECT_SEVERITY),
        *(Rule(f"difficulties.*.effect_range.{effect}.{key}", "pair", 0.0, 100.0) for effect, keys in V.EFFECT_RANGES.items() for key in keys),
    ]


def generator_rules() -> list[Rule]:
    """The rules of a generator's configuration, a row each; those of a level once for every level."""
    out = [Rule(name, kind, low, high, below) for name, (kind, low, high, below) in V.GENERATOR_SETTINGS.items()]
    out += [Rule(f"class_weights.{k}", "weight", 0.0, required=False) for k in V.CLASS_WEIGHTS] + [Rule(f"difficulty_weights.{k}", "weight", 0.0, required=False) for k in LEVELS]
    out += [Rule("font", "choice", choices=("stroke",))]
    for rule in _level_rules():
        out += [Rule(rule.name.replace("*", level), rule.kind, rule.low, rule.high, rule.below) for level in LEVELS]
    return out


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    real = lambda x: None if x is None else float(x)
    rows = [(r.name, r.kind, real(r.low), real(r.high), r.below, list(r.choices), r.required) for r in rules]
    return spark.createDataFrame(rows, "name string, kind string, low double, high double, below boolean, choices array<string>, required boolean")


NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _outside(value: Column) -> Column:
    return (value < F.col("low")) | (value > F.col("high")) | (F.col("below") & (value == F.col("high")))


def _fault() -> Column:
    """What is wrong with a value by its rule's kind; null if nothing is."""
    value, kind = F.col("value"), F.col("kind")
    number = _number(value)
    parts = F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda p: F.when(F.trim(p).rlike(NUMBER), F.trim(p).try_cast("double")))
    low, high = F.get("__pair", F.lit(0)), F.get("__pair", F.lit(1))
    outside = F.lit("is outside its bounds")
    no = lambda test: F.coalesce(test, F.lit(False))  # noqa: E731 - a bound that is not set bounds nothing
    of_pair = F.when((F.size("__pair") != 2) | low.isNull() | high.isNull(), "is no pair of numbers").when(low > high, "is out of order").when(no(_outside(low)) | no(_outside(high)), outside)
    of_number = F.when(number.isNull(), "is no number").when((kind == "whole") & (value.rlike("[.eE]")), "is no whole number").when(no(_outside(number)), outside)
    of_choice = F.when(~F.array_contains("choices", F.btrim(value, F.lit('"'))), "is none of its choices")
    return parts, F.when(kind == "pair", of_pair).when(kind == "choice", of_choice).otherwise(of_number)


#: Settings that meet in one task.
TASK_ROWS = 250_000


def setting_findings(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """(config, name, finding) of settings (config, name, value): unknown, missing and repeated names, values of another kind or out of bounds, families of weights without any.

    The rules, some hundred rows of a parameter, are broadcast; a configuration's names meet in one row, which holds each once.
    Configurations are dealt to as many tasks as their settings need.
    """
    tasks = max(int(settings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-settings.count() // TASK_ROWS))
    known = settings.join(F.broadcast(rules), "name", "left")
    parts, fault = _fault()
    judged = known.withColumn("__pair", parts).withColumn("finding", F.when(F.col("kind").isNull(), "is unknown").when(F.col("value").isNull(), "has no value").otherwise(fault))
    of_values = judged.filter("finding IS NOT NULL").select("config", "name", "finding")
    repeated = settings.repartition(tasks, "config").groupBy("config", "name").count().filter("count > 1").select("config", "name", F.lit("is given more than once").alias("finding"))
    # the required names are one array of the rules' own size
    required = rules.filter("required").agg(F.collect_set("name").alias("names"))
    asked = rules.filter("required").select("name", F.lit(True).alias("asked"))
    marked = settings.select("config", "name").join(F.broadcast(asked), "name", "left").select("config", F.when(F.col("asked"), F.col("name")).alias("name"))
    every = marked.repartition(tasks, "config").groupBy("config").agg(F.collect_set("name").alias("held")).withColumn("__all", required.scalar())
    missing = every.select("config", F.explode(F.array_except("__all", "held")).alias("name"), F.lit("is missing").alias("finding"))
    family = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    weights = judged.filter("kind = 'weight'").select("config", "name", "value").repartition(tasks, "config")
    sums = weights.groupBy("config", family.alias("name")).agg(F.sum(F.greatest(F.coalesce(_number(F.col("value")), F.lit(0.0)), F.lit(0.0))).alias("s"))
    light = sums.filter("s <= 0").select("config", "name", F.lit("has no weight above 0").alias("finding"))
    return of_values.unionByName(repeated).unionByName(missing).unionByName(light)

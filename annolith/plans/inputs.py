"""Input tables of the query catalogue, and annotation-like tables derived from them by expressions that Spark and ANSI engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LETTER = "substr('ABEKMHOPCTYX', cast(({k}) % 12 as int) + 1, 1)"


def _letter(k: str) -> str:
    return _LETTER.format(k=k)


#: Plate strings of many shapes from an order key: with separators, lower case, look-alikes, short and long regions, hidden characters.
PLATE = (
    "case when o_orderkey % 11 = 0 then '' "
    f"when o_orderkey % 7 = 0 then concat({_letter('o_orderkey')}, {_letter('o_custkey')}, ' ', lpad(cast(o_orderkey % 1000 as varchar(10)), 3, '0'), lpad(cast(o_custkey % 100 as varchar(10)), 2, '0')) "
    f"when o_orderkey % 5 = 0 then concat(lower({_letter('o_orderkey')}), '-', lpad(cast(o_custkey % 1000 as varchar(10)), 3, '0'), {_letter('o_custkey + 1')}, {_letter('o_orderkey + 3')}, lpad(cast(o_orderkey % 900 as varchar(10)), 3, '0')) "
    f"when o_orderkey % 13 = 0 then concat({_letter('o_orderkey')}, '#', lpad(cast(o_custkey % 100 as varchar(10)), 2, '0'), {_letter('o_custkey')}, {_letter('o_custkey + 5')}, '77') "
    f"when o_orderkey % 3 = 0 then concat('А', lpad(cast(o_orderkey % 1000 as varchar(10)), 3, '0'), 'В', {_letter('o_custkey')}, '00') "
    f"else concat({_letter('o_orderkey')}, lpad(cast(o_orderkey % 1000 as varchar(10)), 3, '0'), {_letter('o_custkey')}, {_letter('o_custkey + 7')}, lpad(cast(o_custkey % 100 as varchar(10)), 2, '0')) end"
)
PLATE_TYPE = "case cast(o_orderkey % 6 as int) when 0 then 'type1' when 1 then 'type1a' when 2 then 'type1b' when 3 then 'other' when 4 then 'type1' else '' end"

#: Annotation rows, all cells strings, with faults of every kind among them.
META = {
    "line": "cast(o_orderkey + 2 as bigint)",
    "image": (
        "case when o_orderkey % 29 = 0 then '' when o_orderkey % 23 = 0 then concat('../img_', cast(o_custkey as varchar(20)), '.jpg') "
        "when o_orderkey % 2 = 0 then concat('images/synthetic/syn_v2_', cast(o_custkey as varchar(20)), '.jpg') "
        "when o_orderkey % 31 = 0 then concat('photos/', cast(o_custkey as varchar(20)), '.jpg') else concat('images/real/', cast(o_custkey as varchar(20)), '.jpg') end"
    ),
    "plate_num": PLATE,
    "plate_type": PLATE_TYPE,
    "bbox_x": "case when o_orderkey % 37 = 0 then 'x' else cast(o_custkey % 500 as varchar(20)) end",
    "bbox_y": "cast(o_orderkey % 300 as varchar(20))",
    "bbox_w": "case when o_orderkey % 41 = 0 then '0' else '100' end",
    "bbox_h": "'30,0'",
    "quad_x1": "cast(o_custkey % 500 as varchar(20))",
    "quad_y1": "cast(o_orderkey % 300 as varchar(20))",
    "quad_x2": "case when o_orderkey % 43 = 0 then cast(o_custkey % 500 as varchar(20)) else cast(o_custkey % 500 + 100 as varchar(20)) end",
    "quad_y2": "cast(o_orderkey % 300 as varchar(20))",
    "quad_x3": "cast(o_custkey % 500 + 100 + case when o_orderkey % 17 = 0 then 60 else 0 end as varchar(20))",
    "quad_y3": "cast(o_orderkey % 300 + 30 as varchar(20))",
    "quad_x4": "cast(o_custkey % 500 as varchar(20))",
    "quad_y4": "case when o_orderkey % 47 = 0 then 'nan' else cast(o_orderkey % 300 + 30 as varchar(20)) end",
    "is_vehicle": "case cast(o_orderkey % 9 as int) when 0 then 'TRUE' when 1 then ' yes ' when 2 then '' when 3 then 'maybe' else '1' end",
    "is_synthetic": "case when o_orderkey % 19 = 0 then 'unclear' when o_orderkey % 2 = 0 then 'true' else 'no' end",
    "source": "case when o_orderkey % 4 = 1 then '' when o_orderkey % 53 = 0 then 'rejected_source' else concat('src', cast(o_custkey % 5 as varchar(5))) end",
    "license": (
        "case cast(o_custkey % 8 as int) when 0 then 'CC BY 4.0' when 1 then 'CC-BY-SA-4.0' when 2 then 'Creative Commons Attribution 4.0 International' "
        "when 3 then 'CC BY-NC 2.0' when 4 then 'Own work' when 5 then 'non-commercial' when 6 then '' else 'GFDL, version 1.2' end"
    ),
    "conditions": "case cast(o_orderkey % 8 as int) when 0 then 'day|night' when 1 then 'Rain, snow' when 2 then 'fog' when 3 then 'day|day| ' when 4 then '' else 'glare|angle' end",
}
META_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in META.items()) + " FROM orders"

#: A true and a predicted box for each line of an order.
BOXES = {
    "image": "l_orderkey",
    "ordinal": "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as int)",
    "x": "cast(l_partkey % 7 * 20 as double)",
    "y": "cast(l_suppkey % 5 * 15 as double)",
    "w": "60.0 + l_quantity",
    "h": "30.0 + l_linenumber",
    "px": "cast(l_partkey % 7 * 20 + l_linenumber * 2 as double)",
    "py": "cast(l_suppkey % 5 * 15 + l_quantity % 4 as double)",
    "score": "round(l_discount * 8 + 0.1, 2)",
}
BOXES_SQL = "SELECT " + ", ".join(f"cast({v} as double) AS {k}" if k in "xywhpy" else f"{v} AS {k}" for k, v in BOXES.items()) + " FROM lineitem"


def _derived(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{v} AS `{k}`" for k, v in columns.items()))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders", META)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "lineitem", BOXES)

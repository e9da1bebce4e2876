"""Every catalogued query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from annolith import catalogue
from annolith.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(float(v), 7)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = sql.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == expected


def test_all_queries_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)

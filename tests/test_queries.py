"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from serpflow import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(cols).collect())))
    want = sorted(map(repr, duck.execute(f"select {', '.join(cols)} from ({engine.oracle_sql()[name]})").fetchall()))
    assert got and got == want


def test_first_and_best_rules_differ(spark):
    a = {tuple(r) for r in engine.queries()["w1_first_then_filter"](spark, SF).select("query_id", "engine", "pos").collect()}
    b = {tuple(r) for r in engine.queries()["w2_filter_then_best"](spark, SF).select("query_id", "engine", "pos").collect()}
    assert a != b


def test_plans_have_no_cross_product(spark):
    for name in ("t12_similar_pairs", "t9_rank_by_relevance"):
        plan = engine.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan

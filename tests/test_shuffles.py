"""What plans carry through joins and windows."""

import pytest
from pyspark.sql import functions as F

from serpflow import neardup, queries as engine
from serpflow.ranking import furniture, is_like

SF = "/root/testdata/sf0.001"


def nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from nodes(below.apply(i))


@pytest.mark.parametrize("name", ["w1_first_then_filter", "w2_filter_then_best", "b6_is_result_like"])
def test_verdicts_are_shuffled_without_their_texts(spark, name):
    plan = engine.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    moved = [n.output().mkString(" ") for n in nodes(plan) if n.nodeName() in ("Join", "Window")]
    assert moved and not [m for m in moved if "snippet#" in m or "title#" in m]


def test_verdict_of_rows_with_nulls(spark):
    rows = [("A title", "u", "a snippet of words", 0.0), ("A title", "u", "short", 0.05), ("A title", "u", "short", 0.5), ("ab", "u", "a snippet of words", 1.0), (None, "u", "a snippet of words", 1.0), ("A title", None, "a snippet of words", 1.0), ("A title", "u", None, 1.0)]
    d = spark.createDataFrame(rows, "title string, url string, snippet string, score double").coalesce(1)
    got = d.withColumn("found", furniture(F.col("title"), F.col("url"), F.col("snippet"))).select(is_like(F.col("found"), F.col("score"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False, False]


def test_terms_of_one_large_group_are_dealt_once(spark):
    items = spark.createDataFrame([(i, f"a red stone and a blue one {i % 3}") for i in range(9)], "item long, text string")
    u = neardup._vectors(items, 0.85, neardup.WORDS, [])
    plan = u._jdf.queryExecution().executedPlan().toString()
    # document frequencies are found where a term's rows lie, not by a join of them with themselves
    assert "Join [term" not in plan and plan.count("Generate explode") == 2
    assert sorted(r["term"] for r in u.collect() if r["item"] == 0) == sorted(["red", "stone", "and", "blue", "one", "red stone", "stone and", "and blue", "blue one"])

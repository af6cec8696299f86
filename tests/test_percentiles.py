"""Percentiles by radix selection are those of Spark's own function, bit for bit."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rainfold.operators import graph, percentiles
from rainfold.plans import store


@pytest.mark.parametrize("digit,heavy", [(11, 1000), (3, 5)])
def test_equal_to_the_function(spark, monkeypatch, digit, heavy):
    monkeypatch.setattr(percentiles, "DIGIT", digit)
    monkeypatch.setattr(graph, "HEAVY_ROWS", heavy)
    rng = random.Random(digit)
    rows = [("hot", int(rng.paretovariate(0.4)) % 2**40) for _ in range(400)]
    rows += [(f"s{k}", rng.choice((0, 1, 1, 7, 500))) for k in range(12) for _ in range(k + 1)]
    rows += [("one", 2**62 if digit == 11 else 9), (None, 4), ("none", None)]
    df = spark.createDataFrame(rows, "survey string, acc bigint")
    for share in (0.0, 0.37, 0.99, 1.0):
        want = df.where("survey IS NOT NULL AND acc IS NOT NULL").groupBy("survey").agg(F.percentile("acc", F.lit(share)).alias("p"))
        got = percentiles.exact_percentile(df, "survey", "acc", share, "p")
        assert dict(map(tuple, got.collect())) == dict(map(tuple, want.collect()))


def test_no_rows_and_negative_values(spark):
    df = spark.createDataFrame([("a", -1)], "survey string, acc bigint")
    assert percentiles.exact_percentile(df.limit(0), "survey", "acc", 0.5, "p").count() == 0
    with pytest.raises(PySparkException, match="negative"):
        percentiles.exact_percentile(df, "survey", "acc", 0.5, "p").collect()


def test_tasks_go_by_rows(spark, monkeypatch):
    """Values of very many keys compress so well that one task got them all."""
    parts = []
    monkeypatch.setattr(percentiles, "TASK_ROWS", 10)
    monkeypatch.setattr(percentiles, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or store.cut(df))
    rows = spark.range(200).selectExpr("id % 100 AS survey", "id AS acc")
    got = percentiles.exact_percentile(rows, "survey", "acc", 0.5, "p")
    assert {r["survey"]: r["p"] for r in got.collect()} == {k: k + 50.0 for k in range(100)} and parts[-1] == 20

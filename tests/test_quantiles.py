import random
import statistics

import pytest
from pyspark.sql import functions as F

from casetrail.operators import quantiles as Q


@pytest.fixture
def few_fetched(monkeypatch):
    monkeypatch.setattr(Q, "FETCHED", 3)
    monkeypatch.setattr(Q, "BINS", 4)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 50, [3.0] * 25 + [4.0] * 25, [0.0] * 10 + [1e300], [-1.7e308, 1.7e308, 5.0, 6.0, 7.0],
    [random.Random(1).gauss(0, 1) for _ in range(201)], [random.Random(2).expovariate(1) ** 9 for _ in range(200)],
    [float(random.Random(3).randint(0, 3)) for _ in range(100)] + [1e-300, -0.0, 0.0]])
def test_by_refinement(spark, few_fetched, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    assert Q.median(df, "v") == statistics.median(values)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,)], "v double")
    assert Q.median(df, "v") == 2.0
    assert Q.median(df.where("v is null"), "v") is None


def test_many_values_as_spark_has_it(spark):
    df = spark.range(60_000).select(F.expr("pow(abs(hash(id)) % 1000003, 1.5)").alias("v"))
    assert Q.median(df, "v") == df.agg(F.median("v")).first()[0]

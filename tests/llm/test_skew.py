import random

import pytest

from tidemark.llm import skew
from pyspark.sql import functions as F


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("least", [5, 10_000])
def test_salted_join_is_the_join(spark, monkeypatch, how, least):
    """Keys that a third of the rows have, keys that few have, and rows whose key has no partner or is null."""
    monkeypatch.setattr(skew, "LEAST", least)
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "warm", "k1", "k2", None, f"x{i % 40}"])) for i in range(600)]
    big = spark.createDataFrame(rows, "id long, k string")
    one = big.where("k is not null and k not in ('x1', 'x2')").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("top"))
    got = skew.salted_join(big, one, "k", "n", "id", how=how)
    want = big.join(one, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(str, df.select("id", "k", "n", "top").collect()))
    assert key(got) == key(want)


def test_empty_sides(spark):
    big, one = spark.range(0).select("id", F.lit("a").alias("k")), spark.range(0).select(F.lit("a").alias("k"), F.lit(1).alias("n"))
    assert skew.salted_join(big, one, "k", "n", "id").count() == 0

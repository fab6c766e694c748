"""Lookups by a key that is often NULL: the same rows as a plain left join, and nothing shuffled that the reader does not ask for."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.joins import attach


@pytest.mark.parametrize("kind", ["string", "int"])
def test_like_a_left_join(spark, kind):
    lefts = [(None, i, "x") for i in range(30)] + [("1", 1, "y"), ("1", 2, None), ("2", None, "z"), ("9", 9, "z")]
    left = spark.createDataFrame(lefts, "k string, n int, t string").select("n", F.col("k").cast(kind).alias("k"), "t")
    # The text that stands for a NULL key may be a key of its own.
    taken = [r[0] for r in left.select(F.xxhash64("n", "t").cast("string")).collect()] if kind == "string" else []
    right = spark.createDataFrame([("1", "one"), ("2", "two"), (None, "none"), ("7", "seven"), *((k, "taken") for k in taken)], "k string, name string")
    got = attach(left, right.select(F.col("k").cast(kind).alias("k"), "name"), ["k"])
    assert got.columns == ["k", "n", "t", "name"]
    names = {"1": "one", "2": "two"}
    want = [(k if k is None or kind == "string" else int(k), n, t, names.get(k)) for k, n, t in lefts]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_only_columns_that_are_read_are_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(50).selectExpr("CAST(id AS string) AS k", "id AS a", "id AS b", "id AS c", "repeat('w', 9) AS wide")
        right = spark.range(90).selectExpr("CAST(id % 40 AS string) AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v"))
        plan = attach(left, right, ["k"]).select("a", "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The left side once, the right side once by its aggregate.
    assert plan.count("Exchange hashpartitioning") == 2 and "wide" not in plan

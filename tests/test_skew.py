import pytest
from pyspark.sql import functions as F

from weftwork.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("piece", [50, 100_000])
def test_hot_join_is_a_join(spark, how, piece):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 40).alias("key"))
    other = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (5, None), (None, "x"), (99, "y")], "key long, value string")
    got = skew.hot_join(rows, other, ["key"], ["id"], how, piece)
    want = rows.join(other, ["key"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_piece_holds_the_hot_key(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3 * F.col("id")).alias("key"))  # a third of all rows at key 0
    hot, n = skew.hot_keys(rows, ["key"], 100)
    assert n == 1 and [tuple(r) for r in hot.collect()] == [(0, 10)]
    pieces = rows.where("key = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(10))).count().agg(F.max("count")).first()[0]
    assert pieces < 200


def test_empty_sides(spark):
    rows = spark.range(10).select("id", F.lit(1).alias("key"))
    assert skew.hot_join(rows.where("false"), rows.select("key"), ["key"], ["id"], piece=2).count() == 0
    assert skew.hot_join(rows, rows.select("key").where("false"), ["key"], ["id"], "left", piece=2).count() == 10

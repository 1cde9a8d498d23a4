from collections import Counter

from pyspark.sql import functions as F

from weftwork.operators import partition

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def products(spark, n=400):
    group = F.when(F.col("id") % 10 < 2, F.concat(F.lit("g"), F.floor(F.col("id") / 10)))
    return spark.range(1, n + 1).select(F.col("id").alias("product_id"), group.alias("image_group"), F.when(F.col("id") % 5 < 3, "Apparel").when(F.col("id") % 5 == 3, "Footwear").alias("stratum"))


def test_reproducible_and_never_parted(spark):
    rows = partition.memberships(products(spark), {"small": 100, "full": None}, RATIOS).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, partition.memberships(products(spark), {"small": 100, "full": None}, RATIOS).collect()))
    by = {}
    for r in rows:
        group = f"g{r.product_id // 10}" if r.product_id % 10 < 2 else r.product_id
        by.setdefault((r.scale, group), set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    sizes = Counter((r.scale, r.split) for r in rows)
    assert 100 <= sum(v for (s, _), v in sizes.items() if s == "small") <= 101
    assert abs(sizes["full", "train"] - 320) <= 4 and abs(sizes["full", "test"] - 40) <= 4


def test_strata_are_dealt_in_turn(spark):
    dealt = partition.round_robin(partition.groups(products(spark)))
    first = partition.select(dealt, 30).select("stratum").collect()
    assert min(Counter(r.stratum for r in first).values()) >= 6
    places = dealt.groupBy("stratum").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.m == r.n for r in places)


def test_other_seed_other_order(spark):
    a = partition.round_robin(partition.groups(products(spark), 1)).where("turn = 1").select("group_id").collect()
    b = partition.round_robin(partition.groups(products(spark), 2)).where("turn = 1").select("group_id").collect()
    assert a != b


def test_inverted_manifest(spark):
    raw = spark.createDataFrame([("1k", '{"train": [1, 2], "test": [2, 3]}')], "scale string, j string")
    df = raw.select("scale", F.from_json("j", "map<string, array<long>>").alias("splits"))
    assert {(r.product_id, r.split) for r in partition.invert(df).collect()} == {(1, "train"), (2, "test"), (3, "test")}


def test_empty(spark):
    assert partition.memberships(products(spark).limit(0), {"full": None}, RATIOS).count() == 0

"""Quality and latency of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.prefix import prefix, ranges


def recall_at_k(results: DataFrame, reference: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): common results over those of the reference, both to rank k.

    With an empty reference: 1 if the results are empty too, else 0.
    """
    a = results.where(F.col("rank") <= k).select("query_id", "product_id").distinct()
    b = reference.where(F.col("rank") <= k).select("query_id", "product_id").distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["query_id", "product_id"], "full_outer").groupBy("query_id").agg(F.count("x").alias("a"), F.count("y").alias("b"), F.count(F.expr("CASE WHEN x = 1 AND y = 1 THEN 1 END")).alias("both"))
    some = F.when(F.coalesce("b", F.lit(0)) > 0, F.col("both") / F.col("b")).otherwise(F.when(F.coalesce("a", F.lit(0)) > 0, 0.0).otherwise(1.0))
    return queries.select("query_id").distinct().join(both, "query_id", "left").select("query_id", F.round(some, 6).alias("recall"))


def precision_at_k(results: DataFrame, types: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision): results of the query's own type over all its results to rank k; without results 0.

    ``types`` is (product_id, type), ``queries`` (query_id, type). A query without a type has no relevant results. No
    pairs of relevant products are formed.
    """
    top = results.where(F.col("rank") <= k).join(types.select("product_id", F.col("type").alias("has")), "product_id", "left")
    hits = queries.select("query_id", "type").join(top, "query_id", "left").groupBy("query_id").agg(F.count("product_id").alias("n"), F.count(F.when(F.col("has") == F.col("type"), 1)).alias("hit"))
    return hits.select("query_id", F.round(F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0), 6).alias("precision"))


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, median, p95, least, most), of the samples that are numbers.

    p95 is the sample at place round_half_even(0.95 n + 0.5), counted from 1. Exact: equal samples are folded, and
    places are found by sums over the sorted values, so no group's samples are gathered.
    """
    valid = samples.select(F.col(group).alias("group"), F.col(value).cast("double").alias("x")).where("group IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    totals = valid.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))
    folded = valid.groupBy("group", "x").agg(F.count(F.lit(1)).alias("c"))
    placed = prefix(ranges(folded, ["group"], "x"), ["group"], ["x"], {"c": "below"}, False).join(totals.select("group", "n"), "group")

    def at(place):
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("c")), F.col("x")))

    p95 = F.least(F.col("n") - 1, F.greatest(F.lit(0), F.bround(F.col("n") * 0.95 + 0.5).cast("long") - 1))
    picked = placed.groupBy("group").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2).alias("median"), at(p95).alias("p95"))
    return totals.join(picked, "group").select(F.col("group").alias(group), "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "least", "most")])


def tradeoffs(report: DataFrame, lower: list[str], higher: list[str], engine: str = "engine") -> DataFrame:
    """(metric, best): the engine with the least or greatest value; the first by name of equal ones."""
    low = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in lower]
    high = [F.struct(F.lit(m).alias("metric"), (-F.col(m)).cast("double").alias("x")) for m in higher]
    long = report.select(engine, F.explode(F.array(*low, *high)).alias("m")).where("m.x IS NOT NULL")
    return long.groupBy("m.metric").agg(F.min(F.struct("m.x", engine)).alias("b")).select("metric", F.col(f"b.{engine}").alias("best"))

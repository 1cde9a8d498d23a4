"""Late fusion of rankings and their presentation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.textindex import top_k


def max_normalized(rankings: DataFrame) -> DataFrame:
    """Scores over the greatest of their query and modality; all 0 where that isn't above 0."""
    top = F.max("score").over(Window.partitionBy("query_id", "modality"))
    return rankings.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def shares(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights that sum to 1; negative ones and a sum of 0 are refused."""
    total = float(sum(weights.values()))
    if min(weights.values()) < 0 or total <= 0:
        raise ValueError("weights must not be negative, nor all 0")
    return {m: w / total for m, w in weights.items()}


def fuse(rankings: DataFrame, weights: Mapping[str, float], k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, product_id, score, <modality>_score..., rank) from (query_id, product_id, score, modality).

    A product missing from a modality has 0 there; a modality without a weight gives products but no score. The union
    aggregated by product is the full outer join of any number of modalities in one shuffle.
    """
    weight = shares(weights)
    normal = max_normalized(rankings)
    by = normal.groupBy("query_id", "product_id").agg(*[F.coalesce(F.max(F.when(F.col("modality") == m, F.col("score"))), F.lit(0.0)).alias(f"{m}_score") for m in weight])
    total = sum((F.col(f"{m}_score") * w for m, w in weight.items()), F.lit(0.0))
    scored = by.select("query_id", "product_id", F.round(total, digits).alias("score"), *[F.round(f"{m}_score", digits).alias(f"{m}_score") for m in weight])
    return top_k(scored, k)


def enrich(results: DataFrame, catalog: DataFrame, strict: bool = True) -> DataFrame:
    """Results with the columns of the catalogue (product_id, ...); strict: a product that isn't there is an error."""
    if not strict:
        return results.join(catalog, "product_id")
    known = catalog.withColumn("known", F.lit(True))
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no such product: "), F.col("product_id").cast("string")))).otherwise(F.col("product_id"))
    return results.join(known, "product_id", "left").withColumn("product_id", checked).drop("known")


def summary(results: DataFrame) -> DataFrame:
    """(query_id, rank, line): one line of text per result, scores to 4 places."""
    name = F.coalesce("display_name", F.lit("unnamed"))
    return results.select("query_id", "rank", F.concat_ws(" | ", F.col("product_id").cast("string"), name, F.format_string("%.4f", F.bround("score", 4))).alias("line"))

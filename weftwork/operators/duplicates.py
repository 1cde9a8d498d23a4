"""Groups of identical contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest) of contents that stand at more than one key.

    Contents are hashed where they are read; only keys and digests are shuffled. Null contents take no part.
    """
    hashed = rows.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    shared = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return hashed.join(shared, "digest", "left_semi").select(F.col("key").alias(key), "digest")

"""Keeping tables: latest row per key, replaced partitions, resumed work, counts and sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, an aggregate: repeats fold before the shuffle.

    Rows with a null key are dropped; of rows equal in ``order`` the greatest stands.
    """
    rest = [c for c in rows.columns if c not in keys and c != order]
    plain = [c for c in rest if not rows.schema[c].dataType.simpleString().startswith("map")]
    maps = [c for c in rest if c not in plain]
    pick = F.struct(order, *plain, *[F.sort_array(F.map_entries(c)).alias(c) for c in maps])
    top = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(pick).alias("top"))
    out = {c: F.map_from_entries(f"top.{c}") if c in maps else F.col(c) if c in keys else F.col(f"top.{c}") for c in rows.columns}
    return top.select(*[e.alias(c) for c, e in out.items()])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows, the new one where a key is in both."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, "_new").drop("_new")


def upsert_with_images(old: DataFrame, new: DataFrame, keys: Sequence[str], image: str = "image_path") -> DataFrame:
    """``upsert`` of the new rows that have an image; the others leave the table as it is."""
    return upsert(old, new.where(F.length(F.trim(image)) > 0), keys)


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``rows``; partitions they touch are replaced whole, so rows gone from a rebuild don't linger."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do of a resumed build."""
    return wanted.join(done.select(key), key, "left_anti")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) of each."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def bytes_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a table; only file names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

"""Index artifacts at rest: codebooks, postings and memberships as Parquet, laid out for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.maintain import replace_partitions


def save_postings(postings: DataFrame, path: str, modality: str, scale: str, word: str, item: str) -> None:
    """Partitioned by modality and scale, sorted by codeword within files, so that readers skip by file and row group."""
    rows = postings.select(F.lit(modality).alias("modality"), F.lit(scale).alias("scale"), F.col(word).cast("string").alias("codeword_id"), F.col(item).cast("string").alias("item_id"), "product_id", "weight")
    replace_partitions(rows.repartitionByRange("codeword_id").sortWithinPartitions("codeword_id", "item_id"), path, ["modality", "scale"])


def load_postings(spark: SparkSession, path: str, modality: str, scale: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("modality") == modality) & (F.col("scale") == scale)).drop("modality", "scale")


def save_table(rows: DataFrame, path: str, *by: str) -> None:
    replace_partitions(rows, path, by) if by else rows.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(scale, splits) of manifest files {name, splits: {split: [ids]}}; a scale may have several."""
    raw = spark.read.schema("name string, splits map<string, array<long>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return raw.select(F.col("name").alias("scale"), "splits")


def save_manifest(memberships: DataFrame, path: str, most: int = 100_000) -> None:
    """Manifest files of (scale, split, product_id), as ``load_manifest`` and ``partition.invert`` read them.

    A split of more than ``most`` ids goes to several files, so no task gathers a whole scale.
    """
    sizes = memberships.groupBy("scale", "split").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces"))
    placed = memberships.join(sizes, ["scale", "split"]).withColumn("piece", F.pmod(F.xxhash64("product_id"), "pieces"))
    rows = placed.groupBy("scale", "split", "piece").agg(F.sort_array(F.collect_list("product_id")).alias("ids"))
    rows.select(F.col("scale").alias("name"), F.create_map("split", "ids").alias("splits")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)

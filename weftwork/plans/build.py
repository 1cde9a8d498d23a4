"""Building the indexes of a scale: one job per artifact, each written under its modality and scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.config import Settings
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.operators.maintain import missing
from weftwork.sources import artifacts


def of_scale(memberships: DataFrame, scale: str, split: str | None = None) -> DataFrame:
    """(product_id) of a scale, or of one of its splits."""
    rows = memberships.where(F.col("scale") == scale)
    return (rows if split is None else rows.where(F.col("split") == split)).select("product_id").distinct()


def tokens(chunks: DataFrame, settings: Settings) -> DataFrame:
    found = X.tokenized(chunks, stopwords=settings.text.remove_stopwords, lowercase=settings.text.lowercase)
    return X.stemmed(found) if settings.text.stemmer == "porter" else found


def text_index(products: DataFrame, memberships: DataFrame, scale: str, path: str, settings: Settings | None = None) -> DataFrame:
    """Chunks, codebook (of the training split) and postings of (product_id, canonical_text); the summary, one row."""
    s = settings or Settings()
    spark = products.sparkSession
    own = products.join(of_scale(memberships, scale), "product_id", "left_semi")
    artifacts.save_table(X.split_chunks(own, "product_id", "canonical_text", s.text.max_tokens, s.text.overlap).withColumn("scale", F.lit(scale)), f"{path}/chunks", "scale")
    chunks = artifacts.load_table(spark, f"{path}/chunks").where(F.col("scale") == scale)
    train = chunks.join(of_scale(memberships, scale, "train"), "product_id", "left_semi")
    book = X.codebook(tokens(train, s), s.text.max_terms, s.text.min_df).withColumn("scale", F.lit(scale))
    artifacts.save_table(book, f"{path}/text_codebook", "scale")
    book = text_codebook(spark, path, scale)
    artifacts.save_postings(X.tfidf(tokens(chunks, s), book), f"{path}/postings", "text", scale, "term", "chunk_id")
    posted = artifacts.load_postings(spark, f"{path}/postings", "text", scale).withColumnRenamed("codeword_id", "term")
    return X.index_summary(chunks, posted)


def text_codebook(spark: SparkSession, path: str, scale: str) -> DataFrame:
    return artifacts.load_table(spark, f"{path}/text_codebook").where(F.col("scale") == scale).drop("scale")


def descriptors(found: DataFrame, path: str, items: DataFrame, item: str = "item") -> DataFrame:
    """Descriptor rows at rest. Items that are there already aren't extracted again: ``found`` is only planned for the rest."""
    spark = found.sparkSession
    try:
        have = spark.read.parquet(path)
        todo = missing(items, have.select(item).distinct(), item)
        rows = found.join(todo, item, "left_semi")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = found
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def visual_index(descriptor_rows: DataFrame, memberships: DataFrame, scale: str, path: str, settings: Settings | None = None) -> DataFrame:
    """Codebook and postings of (product_id, at, descriptor); the summary, one row. Products without descriptors count."""
    s = settings or Settings()
    spark = descriptor_rows.sparkSession
    ids = of_scale(memberships, scale)
    own = descriptor_rows.join(ids, "product_id", "left_semi")
    usable = V.usable(own.select(F.struct("product_id", "at").alias("place"), "descriptor"), "place", "descriptor").select(F.col("id.product_id").alias("product_id"), F.concat_ws(":", "id.product_id", "id.at").alias("key"), "vector")
    sample = V.sample_descriptors(usable, "product_id", "key", s.vision.sample_size, s.vision.seed).select(F.col("key").alias("id"), "vector")
    artifacts.save_table(V.fit_codebook(sample, s.vision.codebook_size, s.vision.seed).withColumn("scale", F.lit(scale)), f"{path}/visual_codebook", "scale")
    book = artifacts.load_table(spark, f"{path}/visual_codebook").where(F.col("scale") == scale).drop("scale")
    artifacts.save_postings(V.encode(own, book, "product_id"), f"{path}/postings", "image", scale, "word_id", "product_id")
    posted = artifacts.load_postings(spark, f"{path}/postings", "image", scale).select(F.col("codeword_id").alias("word_id"), "product_id", "weight")
    return V.index_summary(ids, posted)

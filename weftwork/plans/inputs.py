"""The test tables as the inputs of operators: each row once, spellings settled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.operators.maintain import latest
from weftwork.sources.catalog import CATEGORIES, read_products
from weftwork.storage import table

DIM = 512


def products(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_products(table(spark, d, "products"), *columns)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector): usable visual vectors, one per product."""
    rows = table(spark, d, "products").select("product_id", "visual_vector", "ingested_at")
    return V.usable(latest(rows, ["product_id"], "ingested_at"), "product_id", "visual_vector", DIM)


def unit_words(spark: SparkSession, d: str) -> DataFrame:
    """(id, words, weights): visual words of products at unit length."""
    return V.unit_words(vectors(spark, d))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return V.usable(table(spark, d, "embeddings"), "vec_id", "embedding")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Text chunks, each once."""
    rows = table(spark, d, "chunks").where("modality = 'text'").select("chunk_id", "product_id", "position", "content")
    return rows.groupBy("chunk_id").agg(F.max(F.struct("product_id", "position", "content")).alias("c")).select("chunk_id", "c.*")


def members(spark: SparkSession, d: str) -> DataFrame:
    """(scale, split, product_id), splits in one spelling; rows with another or no split are left out."""
    return table(spark, d, "dataset_memberships").select("scale", T.split_name("split").alias("split"), "product_id").where("split IS NOT NULL").distinct()


def train_chunks(spark: SparkSession, d: str) -> DataFrame:
    ids = members(spark, d).where("scale = 'full' AND split = 'train'").select("product_id")
    return chunks(spark, d).join(ids, "product_id", "left_semi")


def codebook(spark: SparkSession, d: str) -> DataFrame:
    return X.codebook(X.tokenized(train_chunks(spark, d), stopwords=True))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return X.tfidf(X.tokenized(chunks(spark, d), stopwords=True), codebook(spark, d))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every product whose id is divisible by 20 asks with its own text: (query_id, exclude_id, text)."""
    rows = products(spark, d, "canonical_text").where("product_id % 20 = 0")
    return rows.select(F.col("product_id").alias("query_id"), F.col("product_id").alias("exclude_id"), F.col("canonical_text").alias("text"))


def query_vectors(queries: DataFrame, book: DataFrame) -> DataFrame:
    """(query_id, exclude_id, term, weight) of (query_id, exclude_id, text)."""
    as_chunks = queries.select(F.col("query_id").alias("chunk_id"), F.col("query_id").alias("product_id"), F.col("text").alias("content"))
    weighted = X.tfidf(X.tokenized(as_chunks, stopwords=True), book)
    return weighted.select(F.col("chunk_id").alias("query_id"), "term", "weight").join(queries.select("query_id", "exclude_id"), "query_id")


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, product_id, modality, score): search results with a score, each once."""
    score = F.col("score").cast("double")
    rows = table(spark, d, "search_results").where(score.isNotNull() & ~F.isnan(score))
    return rows.groupBy("query_id", "product_id", "modality").agg(F.max(score).alias("score"))


def names(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d, "metadata").select("product_id", F.col("details.product_display_name").alias("display_name"))


def types(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d, "categories").select("product_id", F.element_at("categories", F.lit("articleType")).alias("type"))


def partition_input(spark: SparkSession, d: str) -> DataFrame:
    return products(spark, d, "duplicate_image_group", "categories").select("product_id", T.digest("duplicate_image_group").alias("image_group"), F.element_at("categories", F.lit("masterCategory")).alias("stratum"))


def canonical_parts() -> list:
    category = {c: F.element_at("categories", F.lit(c)) for c in CATEGORIES}
    return [F.col("details.product_display_name"), *category.values(), F.col("details.brand_name"), F.col("details.description")]

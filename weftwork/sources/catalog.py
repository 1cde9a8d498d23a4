"""Reading a product catalogue from tabular, JSON and image files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators.duplicates import duplicate_groups

#: Columns of the styles table that become categories, in the order of the canonical text.
CATEGORIES = ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage")
STYLES = "id string, " + ", ".join(f"{c} string" for c in CATEGORIES) + ", productDisplayName string"
DETAILS = "data struct<brandName: string, productDescriptors: struct<description: struct<value: string>>, articleAttributes: map<string, string>>"
PRODUCT = "product_id long, canonical_text string, image_path string, categories map<string, string>, metadata struct<product_display_name: string, brand_name: string, description: string, article_attributes: map<string, string>>, has_image boolean, has_description boolean, duplicate_image_group string"


def read_styles(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The styles table with its header; columns are matched by name. ``limit`` takes the smallest ids."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    named = raw.select(*[F.col(f"`{c}`").alias(c.removeprefix(chr(0xFEFF)).strip()) for c in raw.columns])
    have = {c for c in named.columns}
    columns = [c.split()[0] for c in STYLES.split(", ")]
    rows = named.select(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in columns]).withColumn("id", F.col("id").cast("long"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def read_details(spark: SparkSession, folder: str) -> DataFrame:
    """(id, data) of one JSON file per product, named by its id; what isn't an object gives a null."""
    raw = spark.read.schema(DETAILS).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long").alias("id"), "data")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(id, image_path, length, content) of <id>.jpg; content is read only if it is used."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.regexp_extract(name, r"^(\d+)\.jpg$", 1).cast("long").alias("id"), F.concat(F.lit("images/"), name).alias("image_path"), "length", "content").where("id IS NOT NULL")


def image_groups(images: DataFrame) -> DataFrame:
    """(id, duplicate_image_group): identical image files."""
    return duplicate_groups(images, "id", "content").withColumnRenamed("digest", "duplicate_image_group")


def build(styles: DataFrame, details: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """The canonical catalogue: a row per style, with what JSON and images add."""
    joined = styles.join(details, "id", "left").join(images.select("id", "image_path"), "id", "left").join(groups, "id", "left")
    description = T.clean_html(F.coalesce("data.productDescriptors.description.value", F.lit("")))
    prepared = joined.withColumn("description", T.normalize_value(description)).withColumn("brand", T.normalize_value("data.brandName"))
    parts = ["productDisplayName", *CATEGORIES, "brand", "description"]
    return prepared.select(
        F.col("id").alias("product_id"), T.canonical_text(parts, "data.articleAttributes").alias("canonical_text"), "image_path", T.category_map({c: c for c in CATEGORIES}).alias("categories"),
        F.struct(T.normalize_value("productDisplayName").alias("product_display_name"), F.col("brand").alias("brand_name"), "description", F.col("data.articleAttributes").alias("article_attributes")).alias("metadata"),
        F.col("image_path").isNotNull().alias("has_image"), (F.length("description") > 0).alias("has_description"), "duplicate_image_group",
    )


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) as one file each below ``folder``, in the tasks, on the shared file system; how many."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        for batch in batches:
            names = batch.column(0).to_pylist()
            for parent in {n.rpartition("/")[0] for n in names}:
                system.create_dir(f"{root}/{parent}")
            for name, content in zip(names, batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue written as JSON lines; a malformed row is an error, a blank line is none."""
    return spark.read.schema(PRODUCT).option("mode", "FAILFAST").json(path)


def write_catalog(catalog: DataFrame, path: str) -> int:
    """Write JSON lines, and say how many."""
    catalog.write.mode("overwrite").json(path)
    return read_catalog(catalog.sparkSession, path).count()


def read_products(rows: DataFrame, *columns: str) -> DataFrame:
    """(product_id, columns) of the products table, each product once (the row ingested last).

    Only these columns are read. With ``metadata`` comes ``details``, its parsed form.
    """
    from weftwork.operators.maintain import latest

    once = latest(rows.select("product_id", "ingested_at", *columns), ["product_id"], "ingested_at").drop("ingested_at")
    if "metadata" not in columns:
        return once
    return once.withColumn("details", F.from_json("metadata", "product_display_name string, brand_name string, description string, article_attributes map<string, string>"))

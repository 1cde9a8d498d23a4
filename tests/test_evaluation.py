import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import maintain, partition
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.plans import apps, evaluation, instrument
from weftwork.sources import artifacts
from weftwork.streaming import chunks as stream


@pytest.fixture(scope="module")
def shop(spark):
    catalog = spark.createDataFrame([(k, f"red shoe {k}" if k % 2 else f"blue shirt {k}", f"Item {k}", "Shoe" if k % 2 else "Shirt") for k in range(1, 13)], "product_id long, text string, display_name string, type string")
    r = np.random.default_rng(0)
    vectors = spark.createDataFrame([(k, [float(x) for x in np.abs(r.standard_normal(6)) * ([1, 1, 1, 0, 0, 0] if k % 2 else [0, 0, 0, 1, 1, 1])]) for k in range(1, 13)], "id long, vector array<double>")
    return catalog, vectors


def test_reports_over_scales_skip_what_is_missing(spark, shop, tmp_path):
    catalog, vectors = shop
    engines = {e: f for e, f in apps.visual_engines(vectors).items()}
    types = catalog.select("product_id", "type")
    (tmp_path / "index").mkdir()
    report = lambda scale: evaluation.engine_report(apps.by_product(catalog), engines, types, "exact", 3)
    done = evaluation.over_scales(spark, {"1k": str(tmp_path / "index"), "10k": str(tmp_path / "none")}, report, str(tmp_path / "out"))
    assert set(done) == {"1k"} and {r["engine"] for r in done["1k"]} == {"custom", "exact"}
    assert all(r["queries"] == 12 and r["precision"] == 1.0 and r["count"] == 1 and r["per_second"] > 0 for r in done["1k"])
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert summary["skipped"] == ["10k"] and summary["best"]["1k"]["precision"] == "custom"
    assert json.loads((tmp_path / "out" / "1k.json").read_text()) and "<rect" in (tmp_path / "out" / "1k-precision.svg").read_text()
    fused = evaluation.fused_report(apps.by_product(catalog), engines, types, "custom", 3)
    assert {r["engine"]: r["overlap"] for r in fused}["custom"] == 1.0


def test_measures():
    got = instrument.measured([lambda: None] * 10, repeats=2, concurrency=4)
    assert got["count"] == 20 and got["least_ms"] <= got["median_ms"] <= got["p95_ms"] <= got["most_ms"]
    assert instrument.measured([]) == {"count": 0}
    assert [instrument.place(n) for n in (1, 2, 20, 100)] == [0, 1, 19, 95]
    assert instrument.set_up_logging("WARNING").name == "weftwork"
    assert "&lt;b&gt;" in evaluation.bar_chart([{"engine": "<b>", "x": 0}], "x")


def test_plan_text_and_figures(spark, tmp_path):
    spark.range(1000).withColumn("k", F.col("id") % 7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).groupBy("k").count()
    assert "HashAggregate" in instrument.explained(df)
    got = instrument.figures(df)
    assert got["rows"] == 7 and got["bytes_read"] > 0 and got["files_read"] > 0 and got["shuffle_bytes"] > 0 and got["nodes"] > 3


def test_search_by_id_or_image(spark, shop):
    catalog, vectors = shop
    units = V.unit_words(vectors)
    names = catalog.select("product_id", "display_name")
    book = spark.createDataFrame([(k, [float(k == j) for j in range(4)]) for k in range(4)], "word_id int, centroid array<double>")
    ids = spark.createDataFrame([(1,), (2,)], "product_id long")
    rows = apps.search_images(units, names, book, product_ids=ids, k=3).collect()
    assert len(rows) == 6 and all(r.product_id != r.query_id and r.product_id % 2 == r.query_id % 2 and r.engine == "custom" for r in rows)
    image = spark.createDataFrame([(7, (4, 4, 1, bytearray(range(16)))), (8, None)], "query_id long, image struct<height: int, width: int, nChannels: int, data: binary>")
    found = apps.search_images(units, names, book, images=image, k=3, extract=lambda x: np.eye(4)[:2]).collect()
    assert {r.query_id for r in found} == {7} and all(r.product_id % 2 for r in found)
    for wrong in ({}, {"product_ids": ids, "images": image}, {"product_ids": ids, "k": 0}):
        with pytest.raises(ValueError):
            apps.search_images(units, names, book, **wrong)
    with pytest.raises(Exception, match="no such product"):
        apps.search_images(units, names, book, product_ids=spark.createDataFrame([(99,)], "product_id long")).collect()


def test_text_engines(spark, shop):
    catalog, _ = shop
    chunks = catalog.select(F.concat(F.lit("text:"), "product_id", F.lit(":0")).alias("chunk_id"), "product_id", F.col("text").alias("content"))
    tokens = X.tokenized(chunks)
    book = X.codebook(tokens, min_df=1)

    def vectors(q):
        words = X.tfidf(X.tokenized(q.select(F.col("query_id").alias("chunk_id"), F.col("query_id").alias("product_id"), F.col("text").alias("content"))), book)
        return words.select(F.col("chunk_id").alias("query_id"), "term", "weight").join(q.select("query_id", "exclude_id"), "query_id")

    lexemes = X.lexemes(catalog.select("product_id", "text"))
    engines = apps.text_engines(X.tfidf(tokens, book), vectors, lexemes)
    asked = spark.createDataFrame([(1, 1, "red shoe"), (2, None, " "), (3, None, None)], "query_id long, exclude_id long, text string")
    for name, engine in engines.items():
        rows = apps.tagged(name, engine(asked, 4)).collect()
        assert len(rows) == 4 and all(r.query_id == 1 and r.product_id % 2 and r.product_id != 1 and r.engine == name for r in rows)
    members = spark.createDataFrame([(3,), (4,)], "product_id long")
    only = apps.text_engines(X.tfidf(tokens, book), vectors, lexemes, members)["full_text"](asked, 4)
    assert {r.product_id for r in only.collect()} == {3}
    assert apps.check_modality("text", "text", "image") == "text"
    with pytest.raises(ValueError, match="not 'audio'"):
        apps.check_modality("audio", "text")


def test_manifests_read_back_in_pieces(spark, tmp_path):
    rows = [("1k", s, k) for k, s in enumerate(["train"] * 25 + ["test"] * 4)] + [("full", "train", 3)]
    artifacts.save_manifest(spark.createDataFrame(rows, "scale string, split string, product_id long"), str(tmp_path / "m"), most=10)
    back = artifacts.load_manifest(spark, str(tmp_path / "m"))
    assert back.count() > 3 and sorted(map(tuple, partition.invert(back).select("scale", "split", "product_id").collect())) == sorted(rows)


def test_upsert_of_rows_with_images(spark):
    old = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg")], "product_id long, image_path string")
    new = spark.createDataFrame([(1, None), (2, "c.jpg"), (3, " "), (4, "d.jpg")], "product_id long, image_path string")
    assert {r.product_id: r.image_path for r in maintain.upsert_with_images(old, new, ["product_id"]).collect()} == {1: "a.jpg", 2: "c.jpg", 4: "d.jpg"}


def test_a_stream_counts_repeats_once_and_drops_emptied_chunks(spark, tmp_path):
    schema = "chunk_id string, product_id long, content string"
    source, path = tmp_path / "in", str(tmp_path / "out")

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        stream.maintain_postings(spark.readStream.schema(schema).parquet(str(source)), path, str(tmp_path / "ck")).awaitTermination(120)
        return sorted((r.chunk_id, r.term, r.n) for r in spark.read.parquet(path).collect())

    assert feed([("a", 1, "red red shoe"), ("a", 1, "red red shoe"), ("b", 2, "hat")]) == [("a", "red", 2), ("a", "shoe", 1), ("b", "hat", 1)]
    assert feed([("b", 2, ""), (None, 3, "x")]) == [("a", "red", 2), ("a", "shoe", 1)]  # alone in its bucket

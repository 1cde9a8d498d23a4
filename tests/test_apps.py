import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.config import Settings, TextSettings, VisionSettings
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.plans import apps, build


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(k, f"red leather shoe number {k} for running" if k % 2 else f"blue cotton shirt number {k}", f"Item {k}", "Shoe" if k % 2 else "Shirt") for k in range(1, 21)]
    return spark.createDataFrame(rows, "product_id long, canonical_text string, display_name string, type string")


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([("1k", "train" if k < 16 else "test", k) for k in range(1, 20)], "scale string, split string, product_id long")


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    rows = [(k, [float(x) for x in np.abs(r.standard_normal(6)) * ([1, 1, 1, 0, 0, 0] if k % 2 else [0, 0, 0, 1, 1, 1])]) for k in range(1, 21)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_text_index_of_a_scale(spark, catalog, members, tmp_path):
    summary = build.text_index(catalog, members, "1k", str(tmp_path), Settings(text=TextSettings(max_terms=50))).first()
    assert summary.chunks == 19 and summary.terms > 3
    terms = {r.term for r in build.text_codebook(spark, str(tmp_path), "1k").collect()}
    assert "run" in terms and "shoe" in terms and "for" not in terms
    again = build.text_index(catalog, members, "1k", str(tmp_path), Settings(text=TextSettings(max_terms=3, stemmer="none"))).first()
    assert again.terms == 3  # the old codewords are gone


def test_visual_index_and_resume(spark, members, tmp_path):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, a, [float(x) for x in r.standard_normal(4)]) for k in range(1, 15) for a in range(5)], "product_id long, at int, descriptor array<double>")
    items = rows.select("product_id").distinct()
    kept = build.descriptors(rows.where("product_id < 8"), str(tmp_path / "d"), items, "product_id")
    assert kept.count() == 35
    assert build.descriptors(rows, str(tmp_path / "d"), items, "product_id").count() == 70
    summary = build.visual_index(rows, members, "1k", str(tmp_path), Settings(vision=VisionSettings(codebook_size=4, sample_size=50))).first()
    assert summary.products == 19 and summary.visual_words == 4


def test_engines_agree_and_self_is_left_out(catalog, vectors):
    engines = apps.visual_engines(vectors, V.fit_codebook(vectors, 2), probes=1)
    queries = apps.by_product(catalog.where("product_id <= 6"))
    rows = {e: apps.visual_search(queries, engines, catalog.select("product_id", "display_name"), e, 5).collect() for e in engines}
    key = lambda e: sorted((r.query_id, r["rank"], r.product_id) for r in rows[e])
    assert key("custom") == key("exact") == key("cells") and all(r.query_id != r.product_id and r.display_name for r in rows["exact"])
    report = {r.engine: (r.queries, r.precision, r.recall) for r in apps.evaluate(queries, engines, catalog.select("product_id", "type"), k=5).collect()}
    assert report == {e: (6, 1.0, 1.0) for e in engines}


def test_recommendations(catalog, vectors):
    chunks = X.split_chunks(catalog, "product_id", "canonical_text")
    tok = X.tokenized(chunks, stopwords=True)
    posted = X.tfidf(tok, X.codebook(tok))

    def text(queries, k):
        asked = queries.join(posted.select(F.col("product_id").alias("ask_id"), "term", "weight"), "ask_id").select("query_id", "exclude_id", "term", "weight")
        return X.top_k(X.best_chunk(asked, posted), k)

    queries = apps.by_product(catalog.where("product_id = 3"))
    rows = apps.recommend(queries, text, apps.visual_engines(vectors)["custom"], catalog.select("product_id", "display_name")).orderBy("rank").collect()
    assert len(rows) == 10 and rows[0]["rank"] == 1 and all(r.product_id != 3 for r in rows)
    assert sum(r.product_id % 2 for r in rows[:9]) == 9


def test_unknown_engine_and_bad_k(catalog, vectors):
    engines = apps.visual_engines(vectors)
    with pytest.raises(ValueError):
        apps.visual_search(apps.by_product(catalog), engines, catalog, "other")
    with pytest.raises(ValueError):
        apps.visual_search(apps.by_product(catalog), engines, catalog, "exact", 0)

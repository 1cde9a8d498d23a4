import pytest
from pyspark.sql import functions as F

from weftwork.operators import fusion, metrics


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id long, product_id long, score double, modality string")


def test_fusion_order(spark):
    rows = ranking(spark, [(1, 2, 1.0, "text"), (1, 3, 0.5, "text"), (1, 3, 1.0, "image"), (1, 2, 0.2, "image")])
    got = fusion.fuse(rows, {"text": 0.4, "image": 0.6}).orderBy("rank").collect()
    assert [(r.product_id, r.score) for r in got] == [(3, pytest.approx(0.8)), (2, pytest.approx(0.52))]


def test_fusion_of_one_sided_and_worthless_modalities(spark):
    rows = ranking(spark, [(1, 2, 0.0, "text"), (1, 9, -1.0, "text"), (1, 3, 4.0, "image"), (1, 5, 2.0, "sound")])
    got = {r.product_id: r.score for r in fusion.fuse(rows, {"text": 9, "image": 11}).collect()}
    assert got == {2: 0.0, 9: 0.0, 3: pytest.approx(0.55), 5: 0.0}


@pytest.mark.parametrize("weights", [{"text": -1, "image": 2}, {"text": 0, "image": 0}])
def test_bad_weights(spark, weights):
    with pytest.raises(ValueError):
        fusion.fuse(ranking(spark, [(1, 2, 1.0, "text")]), weights)


def test_enrich_is_strict(spark):
    results = spark.createDataFrame([(1, 7)], "query_id long, product_id long")
    names = spark.createDataFrame([(8, "x")], "product_id long, display_name string")
    with pytest.raises(Exception, match="no such product"):
        fusion.enrich(results, names).collect()
    assert fusion.enrich(results, names, strict=False).count() == 0


def test_summary_line(spark):
    rows = spark.createDataFrame([(1, 1, 7, 0.123449, None)], "query_id long, rank int, product_id long, score double, display_name string")
    assert fusion.summary(rows).first()["line"] == "7 | unnamed | 0.1234"


def test_recall_and_precision(spark):
    top = lambda *ids: spark.createDataFrame([(1, p, k) for k, p in enumerate(ids, 1)], "query_id long, product_id long, rank int")
    asked = spark.createDataFrame([(1, "shoe"), (2, None)], "query_id long, type string")
    assert {r.query_id: r.recall for r in metrics.recall_at_k(top(1, 2), top(2, 3), asked).collect()} == {1: 0.5, 2: 1.0}
    kinds = spark.createDataFrame([(1, "shoe"), (2, "hat"), (3, None)], "product_id long, type string")
    assert {r.query_id: r.precision for r in metrics.precision_at_k(top(1, 2), kinds, asked).collect()} == {1: 0.5, 2: 0.0}


@pytest.mark.parametrize("n, p95", [(3, 30.0), (20, 20.0), (40, 38.0)])
def test_latency_places(spark, n, p95):
    values = [10.0, 20.0, 30.0] if n == 3 else [float(k) for k in range(1, n + 1)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", float("nan")), (None, 1.0)], "e string, v double")
    row = metrics.latency_summary(df, "e", "v").first()
    assert row.n == len(values) and row.p95 == p95 and row.median == sorted(values)[len(values) // 2] - (0 if n == 3 else 0.5)


def test_latency_over_value_ranges(spark, monkeypatch):
    from weftwork.operators import prefix

    monkeypatch.setattr(prefix.ranges, "__defaults__", (50,))
    df = spark.range(1000).select(F.lit("a").alias("e"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    row = metrics.latency_summary(df, "e", "v").first()
    assert (row.median, row.p95, row.least, row.most) == (499.5, 949.0, 0.0, 999.0)


def test_tradeoffs(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 9.0)], "engine string, slow double, good double")
    assert {r.metric: r.best for r in metrics.tradeoffs(df, ["slow"], ["good"]).collect()} == {"slow": "a", "good": "b"}

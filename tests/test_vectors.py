import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import blocks, metrics
from weftwork.operators import vectors as V


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vector array<double>")


def asked(rows, where="true"):
    return rows.where(where).select(F.col("id").alias("query_id"), F.col("id").alias("exclude_id"), "vector")


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [float("inf"), 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    assert [r.id for r in V.usable(df, "k", "v", 2).collect()] == [1]


def test_exact_search_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "QUERIES", 30)
    x = np.random.default_rng(0).standard_normal((150, 8))
    x[10] = x[3]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    rows = table(spark, x)
    found = {}
    for r in V.exact_search(rows, asked(rows), 5).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.product_id)
    for q in range(150):
        order = sorted((k for k in range(150) if k != q), key=lambda k: (-s[q, k], k))[:5]
        assert found[q] == order


def test_cells_keep_most_neighbours(spark):
    r = np.random.default_rng(1)
    centers = r.standard_normal((8, 16)) * 4
    x = np.concatenate([c + r.standard_normal((40, 16)) for c in centers])
    rows = table(spark, x)
    q = asked(rows, "id % 10 = 0")
    exact = V.exact_search(rows, q, 10)
    near = V.ivf_search(rows, q, V.fit_codebook(rows, 8, seed=1), 10, probes=2)
    assert metrics.recall_at_k(near, exact, q).agg(F.avg("recall")).first()[0] > 0.9


def listed(found):
    return sorted((r.query_id, r["rank"], r.product_id, r.score) for r in found.collect())


@pytest.mark.parametrize("seed, zero", [(4, False), (5, True)])
def test_cells_give_every_neighbour_of_vectors_without_clusters(spark, monkeypatch, seed, zero):
    monkeypatch.setattr(V, "BLOCK", 30)
    x = np.random.default_rng(seed).standard_normal((300, 24))
    rows = table(spark, x)
    q = asked(rows, "id % 10 = 0")
    book = V.class_means(rows.withColumn("label", (F.col("id") % 10).cast("int")))
    if zero:
        book = book.unionByName(spark.createDataFrame([(10, [0.0] * 24)], "word_id int, centroid array<double>"))
    assert listed(V.ivf_search(rows, q, book, 10, probes=1)) == listed(V.exact_search(rows, q, 10))


def test_cells_leave_out_what_can_not_be_near(spark):
    x = np.repeat(np.eye(4), 20, axis=0) + np.random.default_rng(6).standard_normal((80, 4)) * 0.01
    rows = table(spark, x)
    q = asked(rows, "id % 10 = 0")
    found = V.ivf_search(rows, q, V.class_means(rows.withColumn("label", F.floor(F.col("id") / 20).cast("int"))), 5, probes=1)
    assert listed(found) == listed(V.exact_search(rows, q, 5))


def test_cells_with_fewer_rows_than_asked_for(spark):
    rows = table(spark, np.random.default_rng(7).standard_normal((6, 3)))
    book = rows.select(F.col("id").cast("int").alias("word_id"), F.col("vector").alias("centroid"))
    assert V.ivf_search(rows, asked(rows), book, 10, probes=1).count() == 30


def test_codebook_needs_enough_vectors(spark):
    with pytest.raises(ValueError):
        V.fit_codebook(table(spark, np.eye(3)), 4)


def test_assignment_ties_go_to_the_smaller_word(spark):
    book = spark.createDataFrame([(5, [1.0, 0.0]), (2, [0.0, 1.0])], "word_id int, centroid array<double>")
    rows = V.assign(table(spark, [[1, 1], [2, 0]]), book).orderBy("id").collect()
    assert [r.word_id for r in rows] == [2, 5]


def test_histograms_and_visual_search(spark):
    words = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (2, 0), (3, 9)], "item long, word_id int")
    h = {(r.item, r.word_id): r.weight for r in V.histograms(words).collect()}
    assert h[1, 0] == pytest.approx(2 / 5**0.5)
    posted = V.histograms(words).select("word_id", F.col("item").alias("product_id"), "weight")
    q = posted.where("product_id = 1").select(F.lit(1).alias("query_id"), F.lit(1).alias("exclude_id"), "word_id", "weight")
    rows = V.visual_search(q, posted).collect()
    assert [(r.product_id, r.score) for r in rows] == [(2, pytest.approx(0.894427))]  # nothing in common: not there


def test_sampling_takes_a_share_of_each(spark):
    rows = spark.range(100).select(F.col("id").alias("vec"), F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("item"))
    got = [r.item for r in V.sample_descriptors(rows, "item", "vec", 20).collect()]
    assert len(got) == 20 and got.count(1) >= 10
    assert got == [r.item for r in V.sample_descriptors(rows, "item", "vec", 20).collect()]


def test_cosine_of_sparse_pairs(spark):
    long = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 2.0), ("c", 3, 1.0)], "id string, word long, weight double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "zz")], "a string, b string")
    assert {(r.a, r.b): r.similarity for r in V.sparse_cosine(long, long, pairs).collect()} == {("a", "b"): pytest.approx(0.707107), ("a", "c"): 0.0, ("b", "zz"): 0.0}


def test_empty_tables(spark):
    none = table(spark, np.zeros((0, 2)))
    rows = table(spark, np.eye(2))
    assert V.exact_search(none, asked(rows)).count() == 0 and V.exact_search(rows, asked(none)).count() == 0


def test_cells_of_empty_tables(spark):
    none, rows = table(spark, np.zeros((0, 2))), table(spark, np.eye(2))
    book = V.class_means(rows.withColumn("label", F.col("id").cast("int")))
    assert V.ivf_search(none, asked(rows), V.class_means(none.withColumn("label", F.lit(1)))).count() == 0
    assert V.ivf_search(rows, asked(none), book).count() == 0 and V.ivf_search(none, asked(rows), book).count() == 0

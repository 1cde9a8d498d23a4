import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork import storage
from weftwork.operators import blocks
from weftwork.operators import textindex as X


def rows(spark, n=120, seed=3):
    """Chunks of products with random words and weights; several chunks of a product are equal."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        words = sorted(set(r.choice(list("abcdefghij"), 4)))
        out += [(f"c{k:03d}", k // 3, w, float(np.round(r.random() * 4) / 4 + 0.25)) for w in words]
    return spark.createDataFrame(out, "chunk_id string, product_id long, term string, weight double")


def queries(spark):
    asked = [(q, None if q == 5 else q, w, 1.0 + q % 2) for q in range(12) for w in "abcdefghij"[q % 7 :: 3]] + [(99, None, "zz", 1.0)]
    return spark.createDataFrame(asked, "query_id long, exclude_id long, term string, weight double")


@pytest.mark.parametrize("size, files", [(7, 2), (10_000, 10_000)])
def test_search_is_best_chunk_cut_to_k(spark, monkeypatch, size, files):
    monkeypatch.setattr(blocks, "ROWS", size)
    monkeypatch.setattr(blocks, "QUERIES", files)
    posted, asked = rows(spark), queries(spark)
    columns = ["query_id", "rank", "product_id", "score", "chunk_id"]
    found, whole = (sorted(tuple(r) for r in df.select(columns).collect()) for df in (X.search(asked, posted, 4), X.top_k(X.best_chunk(asked, posted), 4)))
    assert found == whole and {r[0] for r in found} == set(range(12))


def test_empty_sides(spark):
    posted, asked = rows(spark), queries(spark)
    assert X.search(asked.where("false"), posted).count() == 0
    assert X.search(asked, posted.where("false")).count() == 0


def test_repeated_words_add_up_and_null_arrays_are_empty(spark):
    items = spark.createDataFrame([(1, 1, ["a", "a", "b"], [1.0, 1.0, 5.0]), (2, 2, ["a"], [1.5]), (3, 3, None, None), (4, 4, [], [])], "item long, product_id long, words array<string>, weights array<double>")
    asked = spark.createDataFrame([(7, None, ["a"], [2.0]), (8, 1, ["a", "c"], [1.0, 1.0]), (9, None, None, None)], "query_id long, exclude_id long, words array<string>, weights array<double>")
    found = blocks.sparse_search(items, asked, 5).orderBy("query_id", F.desc("score")).collect()
    assert [(r.query_id, r.product_id, r.score) for r in found] == [(7, 1, 4.0), (7, 2, 3.0), (8, 2, 1.5)]


def test_a_word_in_a_third_of_all_rows(spark):
    many = spark.range(3000).select(F.col("id").alias("item"), F.col("id").alias("product_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"))).otherwise(F.array(F.concat(F.lit("w"), "id"))).alias("words"), F.array(F.lit(1.0)).alias("weights"))
    asked = spark.createDataFrame([(1, 0, ["hot"], [1.0])], "query_id long, exclude_id long, words array<string>, weights array<double>")
    found = blocks.sparse_search(many, asked, 3).groupBy().agg(F.count(F.lit(1)), F.min("product_id")).first()
    assert found[0] >= 3 and found[1] == 3


def test_a_local_folder_is_refused_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


@pytest.mark.parametrize("dense, size", [(0.0, 3), (0.3, 3), (2.0, 3), (0.3, 1_000)])
def test_only_k_rows_of_a_query_come_out_of_all_blocks(spark, monkeypatch, dense, size):
    """As many as brute force, whichever words are dense; scores of 0 and below count where a word is shared."""
    monkeypatch.setattr(blocks, "ROWS", size)
    monkeypatch.setattr(blocks, "BATCH", 4)
    monkeypatch.setattr(blocks, "DENSE", dense)
    r = np.random.default_rng(5)
    pick = lambda low: {w: float(np.round(r.uniform(low, 1), 2)) for w in sorted(set(r.choice(list("aaabbcdefghijkl"), 3).tolist()))}
    items = [(f"i{n:03d}", n % 45, pick(-1 if n % 2 else 0)) for n in range(130)]
    asked = [(q, q if q % 3 else None, pick(-1 if q % 4 == 0 else 0)) for q in range(15)]
    want = []
    for q, exclude, words in asked:
        best = {}
        for name, p, held in items:
            if p != exclude and words.keys() & held.keys():
                best[p] = min(best.get(p, (np.inf, "")), (-round(sum(words[w] * held[w] for w in words.keys() & held.keys()), 4), name))
        want += [(q, p, -low, name) for (low, name), p in sorted(((v, p) for p, v in best.items()), key=lambda x: (x[0][0], x[1]))[:6]]
    flat = lambda rows: [(*a, list(w), list(w.values())) for *a, w in rows]
    held = spark.createDataFrame(flat(items), "item string, product_id long, words array<string>, weights array<double>").repartition(3)
    found = blocks.sparse_search(held, spark.createDataFrame(flat(asked), "query_id long, exclude_id long, words array<string>, weights array<double>"), 6, 4)
    assert sorted((*x[:2], x[2] + 0.0, x[3]) for x in map(tuple, found.collect())) == sorted((q, p, s + 0.0, name) for q, p, s, name in want)

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftwork.operators import textindex as X


def chunks(spark, texts):
    return spark.createDataFrame([(f"text:{k}:0", k, t) for k, t in texts.items()], "chunk_id string, product_id long, content string")


def test_windows_overlap_and_end(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d"), (3, " "), (4, None)], "id long, t string")
    rows = X.split_chunks(df, "id", "t", 4, 2).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.start_token, r.end_token) for r in rows] == [("text:1:0", "a b c d", 0, 4), ("text:1:1", "c d e f", 2, 6), ("text:2:0", "a b c d", 0, 4)]


def test_codebook_and_unit_vectors(spark):
    texts = {1: "red bag red", 2: "red shoe", 3: None, 4: "blue bag"}
    tok = X.tokenized(chunks(spark, texts))
    book = {r.term: r for r in X.codebook(tok, 10, 2).collect()}
    assert set(book) == {"red", "bag"} and book["red"].tf == 3 and book["red"].df == 2 and book["red"].position == 0
    assert book["bag"].idf == pytest.approx(math.log(5 / 3) + 1)
    rows = X.tfidf(tok, X.codebook(tok, 10, 2)).collect()
    length = Counter()
    for r in rows:
        length[r.chunk_id] += r.weight**2
    assert all(v == pytest.approx(1) for v in length.values()) and "text:3:0" not in length
    assert X.index_summary(chunks(spark, texts), X.tfidf(tok, X.codebook(tok, 10, 2))).first().asDict() == {"chunks": 4, "terms": 2, "postings": len(rows)}


def test_search_leaves_out_the_query_and_breaks_ties_by_id(spark):
    tok = X.tokenized(chunks(spark, {1: "red bag", 2: "red bag", 3: "red shoe", 4: "green hat"}))
    posted = X.tfidf(tok, X.codebook(tok, 10, 1))
    asked = posted.where("product_id = 1").select(F.lit(1).alias("query_id"), F.lit(1).alias("exclude_id"), "term", "weight")
    rows = X.top_k(X.best_chunk(asked, posted), 10).orderBy("rank").collect()
    assert [r.product_id for r in rows] == [2, 3] and rows[0].score == 1.0 and [r["rank"] for r in rows] == [1, 2]


def test_stems_keep_order_and_empty_chunks(spark):
    tok = X.tokenized(chunks(spark, {1: "running shoes black", 2: None}))
    rows = {r.product_id: r.tokens for r in X.stemmed(tok).collect()}
    assert rows == {1: ["run", "shoe", "black"], 2: []}


def test_full_text_rank(spark):
    docs = spark.createDataFrame([(1, "red red bag"), (2, "bag"), (3, "hat")], "product_id long, text string")
    asked = spark.createDataFrame([(7, None, "red bag"), (8, 2, "bag -x"), (9, None, " ")], "query_id long, exclude_id long, text string")
    rows = [(r.query_id, r.product_id, r.score) for r in X.fts_rank(asked, docs).orderBy("query_id", "rank").collect()]
    assert rows == [(7, 1, pytest.approx(0.3)), (7, 2, pytest.approx(0.1)), (8, 1, pytest.approx(0.1))]


def test_vector_map_is_the_inverse(spark):
    tok = X.tokenized(chunks(spark, {1: "red bag"}))
    m = X.vector_map(X.tfidf(tok, X.codebook(tok, 5, 1))).first()["vector"]
    assert set(m) == {"red", "bag"} and sum(v * v for v in m.values()) == pytest.approx(1)


def test_counts_match_python(spark):
    text = "A bag's strap, a bag"
    rows = {r.term: r.n for r in X.term_counts(X.tokenized(chunks(spark, {1: text}))).collect()}
    assert rows == Counter(re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", text.lower()))

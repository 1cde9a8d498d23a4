"""Dense vectors and histograms: exact and approximate search, codewords, histograms, visual postings.

Search never forms the product of two tables in SQL. Each pair of a block of queries and a block of rows is one matrix
product in a task, of which only the best k of each query come out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators import blocks
from weftwork.operators.textindex import top_k
from weftwork.storage import cut

#: Rows of one task of a search by cells; centroids that may be sent to every task.
BLOCK, MOST_CENTROIDS = 8_000, 65_536


def usable(df: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """(id, vector) as doubles: vectors that are there, of the length asked for, and not all zeros or unbounded."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    if dim is not None:
        rows = rows.where(F.size("vector") == dim)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("vector", lambda x: x != 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where a length is 0."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def sparse_cosine(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of stated pairs of sparse vectors in long form (id, word, weight); no common word gives 0."""
    norms = lambda df, name: df.groupBy(F.col("id").alias(name)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"n_{name}"))
    met = pairs.join(left.select(F.col("id").alias("a"), "word", F.col("weight").alias("wa")), "a").join(right.select(F.col("id").alias("b"), "word", F.col("weight").alias("wb")), ["b", "word"])
    dots = met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    full = pairs.join(dots, ["a", "b"], "left").join(norms(left, "a"), "a", "left").join(norms(right, "b"), "b", "left")
    return full.select("a", "b", F.round(F.coalesce(F.col("dot") / (F.col("n_a") * F.col("n_b")), F.lit(0.0)), 6).alias("similarity"))


def _block_search(k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack(rows.to_list())
        return x / np.linalg.norm(x, axis=1)[:, None]

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, x = rows["id"].to_numpy(), unit(rows["vector"])
            for at in range(0, len(queries), 100):
                part = queries.iloc[at : at + 100]
                similar = np.round(unit(part["asked"]) @ x.T, digits)
                for qid, exclude, s in zip(part["query_id"], part["exclude_id"], similar):
                    near = np.flatnonzero(s >= np.partition(s, -k - 1)[-k - 1]) if len(s) > k + 1 else np.arange(len(s))
                    near = near[ids[near] != exclude] if exclude == exclude and exclude is not None else near
                    near = near[np.lexsort((ids[near], -s[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": qid, "product_id": ids[near], "score": s[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "product_id": [], "score": []})

    return run


def exact_search(rows: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, product_id, score, rank): the k greatest cosine similarities, those of 0 too, self excluded.

    Block by block (``blocks``): neither table is copied or joined. ``rows`` is (id, vector), ``queries`` (query_id, exclude_id, vector), both as from ``usable``. Scores are rounded
    before they are ordered; of equal ones the smaller id comes first.
    """
    return top_k(blocks.dense_search(rows, queries, k, digits), k)


def sparse(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, word_id, weight): the places that aren't 0."""
    return df.select(F.col(key).alias("id"), F.posexplode(vector).alias("word_id", "weight")).where("weight <> 0").select("id", "word_id", F.col("weight").cast("double").alias("weight"))


def visual_postings(histograms: DataFrame) -> DataFrame:
    """(word_id, product_id, weight) of (id, vector)."""
    return sparse(histograms, "id", "vector").select("word_id", F.col("id").alias("product_id"), "weight")


def unit_words(df: DataFrame) -> DataFrame:
    """(id, words, weights) of (id, vector): the places that aren't 0 and their values at unit length, in the row."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    held = F.filter(F.transform("vector", lambda x, at: F.struct(at.alias("word"), x.cast("double").alias("x"))), lambda e: e["x"] != 0)
    return df.select("id", norm.alias("norm"), held.alias("held")).select("id", F.col("held.word").alias("words"), F.transform("held.x", lambda x: x / F.col("norm")).alias("weights"))


def unit_histograms(df: DataFrame) -> DataFrame:
    """(id, word_id, weight) of (id, vector), at unit length."""
    return unit_words(df).select("id", F.explode(F.arrays_zip("words", "weights")).alias("e")).select("id", F.col("e.words").alias("word_id"), F.col("e.weights").alias("weight"))


def visual_search(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """Top k by scalar product over common visual words; what has none in common doesn't come out.

    ``queries`` is (query_id, exclude_id, word_id, weight), ``postings`` (word_id, product_id, weight), stored or not.
    """
    pairs = F.collect_list(F.struct("word_id", "weight")).alias("p")
    asked = queries.groupBy("query_id", "exclude_id").agg(pairs).select("query_id", "exclude_id", F.col("p.word_id").alias("words"), F.col("p.weight").alias("weights"))
    held = postings.groupBy("product_id").agg(pairs).select(F.col("product_id").alias("id"), F.col("p.word_id").alias("words"), F.col("p.weight").alias("weights"))
    return search_histograms(asked, held, k)


def search_histograms(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``visual_search`` of (query_id, exclude_id, words, weights) in (id, words, weights), rows as from ``unit_words``."""
    held = items.select(F.col("id").alias("item"), F.col("id").alias("product_id"), "words", "weights")
    return top_k(blocks.sparse_search(held, queries, k, 6).drop("item"), k)


def index_summary(histograms: DataFrame, postings: DataFrame) -> DataFrame:
    """(products, visual_words, nonzero_postings); products without postings count too. One row."""
    a = histograms.agg(F.count(F.lit(1)).alias("products"))
    return a.crossJoin(F.broadcast(postings.agg(F.countDistinct("word_id").alias("visual_words"), F.count(F.lit(1)).alias("nonzero_postings"))))


def class_means(rows: DataFrame, word: str = "label") -> DataFrame:
    """(word_id, centroid): the mean vector of each class, from sums per task: one row per class and task moves."""
    return rows.select(F.col(word).alias("word_id"), array_to_vector("vector").alias("v")).groupBy("word_id").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def fit_codebook(rows: DataFrame, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """(word_id, centroid) by k-means over (id, vector). Fewer rows than k are refused."""
    data = rows.select(array_to_vector("vector").alias("features"))
    if data.limit(k).count() < k:
        raise ValueError(f"fewer than {k} vectors")
    model: KMeansModel = KMeans(k=k, seed=seed, maxIter=iterations).fit(data)
    centers = [(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centers, "word_id int, centroid array<double>")


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, word_id): the nearest centroid, the smaller word of equally near ones.

    The codebook's size is checked (at most ``MOST_CENTROIDS``) before it goes to every task.
    """
    book = centroids.orderBy("word_id").limit(MOST_CENTROIDS + 1).collect()
    if len(book) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    kinds = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r["word_id"] for r in book]), np.array([r["centroid"] for r in book], dtype=np.float64)))

    def run(batches):
        words, centers = sent.value
        square = (centers**2).sum(axis=1) if len(centers) else None
        for batch in batches:
            for at in range(0, batch.num_rows if len(words) else 0, 1_000):
                part = batch.slice(at, 1_000)
                x = np.stack([np.asarray(v) for v in part.column(1).to_pylist()])
                near = words[np.argmin(np.round(square[None] - 2 * x @ centers.T, 12), axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.int32())], ["id", "word_id"])

    return rows.select("id", "vector").mapInArrow(run, f"id {kinds}, word_id int")


def histograms(words: DataFrame, item: str = "item") -> DataFrame:
    """(item, word_id, n, weight): counts of each codeword, brought to unit length per item."""
    counts = words.groupBy(item, "word_id").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(item)))
    return counts.withColumn("weight", F.col("n") / norm)


def encode(descriptors: DataFrame, centroids: DataFrame, item: str = "item") -> DataFrame:
    """Histograms (item, word_id, n, weight) of descriptor rows (item, at, descriptor); unusable descriptors take no part."""
    rows = usable(descriptors.select(F.struct(F.col(item).alias("item"), "at").alias("place"), "descriptor"), "place", "descriptor")
    return histograms(assign(rows, centroids).select(F.col("id.item").alias(item), "word_id"), item)


def sample_descriptors(rows: DataFrame, item: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """About ``target`` rows, each item giving its share (at least one), in the order of a hash; never more than target."""
    sizes = rows.groupBy(item).agg(F.count(F.lit(1)).alias("available"))
    whole = rows.agg(F.count(F.lit(1)).alias("all"))  # one row
    quota = sizes.crossJoin(F.broadcast(whole)).select(item, F.least("available", F.greatest(F.lit(1), F.bround(F.lit(float(target)) * F.col("available") / F.col("all")))).cast("int").alias("quota"))
    drawn = rows.withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256))
    place = F.row_number().over(Window.partitionBy(item).orderBy("draw"))
    return drawn.withColumn("place", place).join(quota, item).where("place <= quota").orderBy("draw").limit(target).drop("draw", "place", "quota")


def ivf_search(rows: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """The same result as ``exact_search``, cell by cell: rows lie in the cell of their nearest centroid.

    A query visits its ``probes`` nearest cells first, then every other cell that may hold a row as similar as its k-th
    so far: no row of a cell is nearer to the query than the angle to the centroid less the greatest angle within the
    cell. Where cells overlap so much that this leaves none out, all rows are read. ``probes`` changes the work only.

    Cells of more than ``BLOCK`` rows are cut; the same matrix product then works cell by cell.
    """
    book = centroids.orderBy("word_id").limit(MOST_CENTROIDS + 1).collect()
    if len(book) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    context = rows.sparkSession.sparkContext
    words, centers = np.array([r["word_id"] for r in book]), np.array([r["centroid"] for r in book], dtype=np.float64)
    sent = context.broadcast((words, centers))
    cells = assign(rows, centroids).withColumnRenamed("word_id", "cell")
    held = cut(rows.join(cells, "id").select("id", "vector", "cell"))

    def angles(x, centers):
        """Angles to the centroids; a centroid of zeros has no direction, so all that is known is 0."""
        norms = np.linalg.norm(centers, axis=1)
        near = np.clip(x @ (centers / np.where(norms > 0, norms, 1)[:, None]).T / np.linalg.norm(x, axis=1)[:, None], -1, 1)
        return np.where(norms > 0, np.arccos(near), 0)

    def spread(batches):
        words, centers = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                own = np.searchsorted(words, part.column(1).to_numpy())
                x = np.stack([np.asarray(v) for v in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(angles(x, centers)[np.arange(len(x)), own])], ["cell", "angle"])

    sizes = cut(held.select("vector", "cell").mapInArrow(spread, "cell int, angle double").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces"), F.max("angle").alias("radius")))
    radius = {r["cell"]: r["radius"] for r in sizes.collect()}  # a row per centroid at most
    reach = context.broadcast(np.array([radius.get(w, -np.inf) for w in words.tolist()]))

    def visit(batches):
        words, centers = sent.value
        square = (centers**2).sum(axis=1) if len(words) else None
        for batch in batches:
            for at in range(0, batch.num_rows if len(words) else 0, 1_000):
                part = batch.slice(at, 1_000)
                x = np.stack([np.asarray(v) for v in part.column(2).to_pylist()])
                near = words[np.argsort(square[None] - 2 * x @ centers.T, axis=1)[:, :probes]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], ["query_id", "exclude_id", "asked", "cells"])

    def further(batches):
        words, centers = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x = np.stack([np.asarray(v) for v in part.column(2).to_pylist()])
                least = np.array([-np.inf if s is None else s for s in part.column(4).to_pylist()])
                # Scores are rounded to 6 places: what might round up to the k-th is visited too.
                may = (np.cos(np.maximum(angles(x, centers) - reach.value[None], 0)) >= least[:, None] - 2e-6) & np.isfinite(reach.value)[None]
                more = [np.setdiff1d(words[m], np.array(seen)).tolist() for m, seen in zip(may, part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(more, pa.list_(pa.int32()))], ["query_id", "exclude_id", "asked", "cells"])

    def best(asked):
        visits = asked.select("query_id", "exclude_id", "asked", F.explode("cells").alias("cell")).join(sizes, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        cutup = held.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).select("id", "vector", "cell", "piece")
        asked_ = visits.select("query_id", "exclude_id", "asked", "cell", "piece")
        found = cutup.groupBy("cell", "piece").cogroup(asked_.groupBy("cell", "piece")).applyInPandas(_block_search(k, 6), "query_id long, product_id long, score double")
        return top_k(found, k)

    form = "query_id long, exclude_id long, asked array<double>, cells array<int>"
    first = cut(queries.select(F.col("query_id").cast("long"), F.col("exclude_id").cast("long"), F.col("vector").alias("asked")).mapInArrow(visit, form))
    near = cut(best(first))
    kth = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    second = first.join(kth, "query_id", "left").select("query_id", "exclude_id", "asked", "cells", "least").mapInArrow(further, form)
    rest = best(second)
    return top_k(near.unionByName(rest).select("query_id", "product_id", "score"), k)

"""The two applications over batches of queries, with the engine as a parameter."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.config import SearchSettings
from weftwork.operators import fusion, metrics
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.sources import media

#: An engine takes (queries, k) and gives (query_id, product_id, score, rank).
Engine = Callable[[DataFrame, int], DataFrame]


def visual_engines(vectors: DataFrame, centroids: DataFrame | None = None, probes: int = 8) -> dict[str, Engine]:
    """Engines by name over (id, vector): ``custom`` (inverted lists), ``exact``, and ``cells`` if there are centroids."""
    units = V.unit_words(vectors)

    def custom(queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", "exclude_id", F.col("ask_id").alias("id")).join(units, "id").select("query_id", "exclude_id", "words", "weights")
        return V.search_histograms(asked, units, k)

    def with_vectors(queries: DataFrame) -> DataFrame:
        return queries.join(vectors.select(F.col("id").alias("ask_id"), "vector"), "ask_id").select("query_id", "exclude_id", "vector")

    engines: dict[str, Engine] = {"custom": custom, "exact": lambda q, k: V.exact_search(vectors, with_vectors(q), k)}
    if centroids is not None:
        engines["cells"] = lambda q, k: V.ivf_search(vectors, with_vectors(q), centroids, k, probes)
    return engines


def text_engines(postings: DataFrame, query_vectors: Callable[[DataFrame], DataFrame], lexemes: DataFrame, members: DataFrame | None = None) -> dict[str, Engine]:
    """Engines by name over stored postings: ``custom`` (best chunk by tf-idf) and ``full_text`` (lexeme rank).

    Queries are (query_id, exclude_id, text); ``query_vectors`` turns them into (query_id, exclude_id, term, weight). Blank
    texts find nothing.
    """
    return {
        "custom": lambda q, k: X.search(query_vectors(q), postings, k).select("query_id", "product_id", "score", "rank"),
        "full_text": lambda q, k: X.lexeme_rank(q, lexemes, members, k=k).select("query_id", "product_id", "score", "rank"),
    }


def check_modality(modality: str, *known: str) -> str:
    """The modality if an engine knows it, else an error."""
    if modality not in known:
        raise ValueError(f"this engine searches {' or '.join(known)}, not {modality!r}")
    return modality


def tagged(engine: str, found: DataFrame) -> DataFrame:
    """Results with the name of the engine that found them."""
    return found.withColumn("engine", F.lit(engine))


def image_queries(images: DataFrame, centroids: DataFrame, extract: media.Extractor = media.gradient_descriptors) -> DataFrame:
    """(query_id, exclude_id, words, weights) of (query_id, image): images as queries, by their visual words.

    A null image, or one without descriptors, asks for nothing and finds nothing; nothing is left out of its results.
    """
    known = images.where("image IS NOT NULL").select(F.col("query_id").cast("string").alias("path"), "image")
    words = V.encode(media.image_descriptors(known, extract).withColumnRenamed("path", "query_id"), centroids, "query_id")
    held = words.groupBy("query_id").agg(F.collect_list(F.struct("word_id", "weight")).alias("p"))
    return held.select(F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("long").alias("exclude_id"), F.col("p.word_id").alias("words"), F.col("p.weight").alias("weights"))


def search_images(units: DataFrame, catalog: DataFrame, centroids: DataFrame, product_ids: DataFrame | None = None, images: DataFrame | None = None, k: int = 10, extract: media.Extractor = media.gradient_descriptors) -> DataFrame:
    """The k most similar products of products by id, or of images: exactly one of the two.

    ``units`` is (id, words, weights). A product asks with its own words and is left out; one that isn't there is an error.
    """
    if (product_ids is None) == (images is None):
        raise ValueError("give product ids or images, not both")
    if k <= 0:
        raise ValueError("k must be positive")
    if images is not None:
        asked = image_queries(images, centroids, extract)
    else:
        found = product_ids.select(F.col("product_id").alias("id")).distinct().join(units, "id", "left")
        missing = F.when(F.col("words").isNull(), F.raise_error(F.concat(F.lit("no such product with an image: "), F.col("id").cast("string")))).otherwise(F.col("id"))
        asked = found.select(missing.alias("query_id"), F.col("id").alias("exclude_id"), "words", "weights")
    return fusion.enrich(tagged("custom", V.search_histograms(asked, units, k)), catalog)


def by_product(products: DataFrame) -> DataFrame:
    """Queries (query_id, exclude_id, ask_id): each product asks with itself and is left out."""
    return products.select(F.col("product_id").alias("query_id"), F.col("product_id").alias("exclude_id"), F.col("product_id").alias("ask_id"))


def pick(engines: Mapping[str, Engine], name: str) -> Engine:
    if name not in engines:
        raise ValueError(f"no engine {name!r}; there are {', '.join(sorted(engines))}")
    return engines[name]


def visual_search(queries: DataFrame, engines: Mapping[str, Engine], catalog: DataFrame, engine: str = "custom", k: int = 10) -> DataFrame:
    """The k most similar products of each query, with the columns of the catalogue."""
    if k <= 0:
        raise ValueError("k must be positive")
    return fusion.enrich(tagged(engine, pick(engines, engine)(queries, k)), catalog)


def recommend(queries: DataFrame, text: Engine, image: Engine, catalog: DataFrame, settings: SearchSettings | None = None) -> DataFrame:
    """Text and image candidates, several times as many as asked for, fused and enriched. Both searches are one plan."""
    s = settings or SearchSettings()
    n = s.top_k * s.candidate_multiplier
    both = [found(queries, n).select("query_id", "product_id", "score", F.lit(m).alias("modality")) for m, found in (("text", text), ("image", image))]
    return fusion.enrich(fusion.fuse(both[0].unionByName(both[1]), s.weights, s.top_k), catalog)


def evaluate(queries: DataFrame, engines: Mapping[str, Engine], types: DataFrame, reference: str = "exact", k: int = 10) -> DataFrame:
    """(engine, queries, precision, recall) of each engine; recall is against the reference engine.

    A query's relevant products are those of its own type.
    """
    truth = pick(engines, reference)(queries, k)
    asked = queries.select("query_id", F.col("ask_id").alias("product_id")).join(types, "product_id", "left").select("query_id", "type")
    out = None
    for name, engine in engines.items():
        found = engine(queries, k)
        rows = metrics.precision_at_k(found, types, asked, k).join(metrics.recall_at_k(found, truth, asked, k), "query_id").groupBy().agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))
        rows = rows.select(F.lit(name).alias("engine"), "queries", "precision", "recall")
        out = rows if out is None else out.unionByName(rows)
    return out

"""All queries of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators import duplicates, fusion, maintain, metrics, partition
from weftwork.operators import textindex as X
from weftwork.operators import vectors as V
from weftwork.operators.prefix import prefix
from weftwork.plans import evaluation
from weftwork.plans import inputs as I
from weftwork.plans import sql
from weftwork.sources import artifacts, catalog
from weftwork.sources.catalog import CATEGORIES
from weftwork.storage import cut, remove_path, scratch_path, table

FLAGSHIP = "text_search"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WEIGHTS = {"text": 0.45, "image": 0.55}
COUNTED = ("products", "dataset_memberships", "chunks", "search_queries", "search_results", "documents", "embeddings", "events")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Sources and maintenance


@query
def scan_catalog(spark, d):
    return I.products(spark, d, "canonical_text", "image_path", "has_image", "has_description").select("product_id", "canonical_text", "image_path", "has_image", "has_description")


@query
def table_counts(spark, d):
    return maintain.counts({t: table(spark, d, t) for t in COUNTED})


@query
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query
def product_details(spark, d):
    details = lambda c: F.col(f"details.{c}")
    return I.products(spark, d, "metadata").select("product_id", details("product_display_name").alias("display_name"), details("brand_name").alias("brand"), F.coalesce(details("description"), F.lit("")).alias("description"))


@query
def upsert_latest(spark, d):
    keys = ["query_id", "product_id", "modality"]
    rows = table(spark, d, "search_results").select(*keys, "ingested_at", "rank", F.when(~F.isnan("score"), F.col("score")).alias("score"))
    return maintain.latest(rows, keys, "ingested_at").select(*keys, "rank", "score")


@query
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(table(spark, d, "documents"), "doc_id", "text")


@query
def canonical_catalog(spark, d):
    """The catalogue built from files: a styles table, a JSON file and an image per product, written first.

    Image bytes are the digest of the product's image group, so that files of a group are the same.
    """
    path = scratch_path(spark, "files")
    rows = cut(I.products(spark, d, "metadata", "categories", "image_path", "duplicate_image_group"))
    styles = rows.select(F.col("product_id").alias("id"), *[F.element_at("categories", F.lit(c)).alias(c) for c in CATEGORIES], F.col("details.product_display_name").alias("productDisplayName"))
    styles.write.option("header", True).option("escape", '"').csv(f"{path}/styles.csv")
    data = F.struct(F.col("details.brand_name").alias("brandName"), F.struct(F.struct(F.col("details.description").alias("value")).alias("description")).alias("productDescriptors"), F.col("details.article_attributes").alias("articleAttributes"))
    files = [
        rows.select(F.concat(F.lit("styles/"), "product_id", F.lit(".json")).alias("name"), F.encode(F.to_json(F.struct(data.alias("data"))), "utf-8").alias("content")),
        rows.where("image_path IS NOT NULL").select(F.concat(F.lit("images/"), "product_id", F.lit(".jpg")).alias("name"), F.encode(F.coalesce(T.digest("duplicate_image_group"), F.col("product_id").cast("string")), "utf-8").alias("content")),
    ]
    for part in files:
        catalog.write_files(part, path)
    images = catalog.read_images(spark, f"{path}/images")
    built = cut(catalog.build(catalog.read_styles(spark, f"{path}/styles.csv"), catalog.read_details(spark, f"{path}/styles"), images, catalog.image_groups(images)))
    remove_path(spark, path)
    return built.select("product_id", "canonical_text", "has_image", F.col("duplicate_image_group").isNotNull().alias("shares_image"), F.size("categories").alias("categories"), F.size("metadata.article_attributes").alias("attributes"))


@query
def sorted_catalog(spark, d):
    """The catalogue in the order of its ids, with the place of each product in it."""
    rows = partition_prefix(evaluation.sorted_catalog(I.products(spark, d, "canonical_text")))
    return rows.select("product_id", "place", "canonical_text")


def partition_prefix(rows):
    """Adds ``place`` (1..n) in the order of the ids, each of 256 ranges of ids counted apart."""
    span = rows.agg(F.min("product_id").alias("low"), F.max("product_id").alias("high"))  # one row
    piece = F.floor((F.col("product_id") - F.col("low")) * 256 / (F.col("high") - F.col("low") + 1)).cast("int")
    pieces = rows.crossJoin(F.broadcast(span)).withColumn("piece", piece).withColumn("one", F.lit(1).cast("long")).drop("low", "high")
    return prefix(pieces, [], ["product_id"], {"one": "place"}, True)


@query
def upsert_images(spark, d):
    """Products of before 2024 in the order of ingestion, then the others, of which only those with an image count."""
    rows = table(spark, d, "products").select("product_id", "image_path", "has_image", "ingested_at").where("product_id IS NOT NULL")
    half = rows.agg(F.expr("timestamp_micros(CAST((unix_micros(min(ingested_at)) + unix_micros(max(ingested_at))) / 2 AS BIGINT))").alias("half"))  # one row
    known = rows.crossJoin(F.broadcast(half))
    old, new = (maintain.latest(known.where(c).drop("half"), ["product_id"], "ingested_at") for c in ("ingested_at <= half", "ingested_at > half"))
    return maintain.upsert_with_images(old, new, ["product_id"]).select("product_id", "image_path", "has_image")


# Cleaning and projection


@query
def normalize_ws(spark, d):
    return I.chunks(spark, d).select("chunk_id", T.normalize_whitespace("content").alias("content"))


@query
def clean_html(spark, d):
    return I.chunks(spark, d).select("chunk_id", T.clean_html("content").alias("content"))


@query
def normalize_value(spark, d):
    return I.products(spark, d, "duplicate_image_group", "metadata").select("product_id", T.normalize_value("duplicate_image_group").alias("image_group"), T.normalize_value("details.brand_name").alias("brand"))


@query
def safe_slug(spark, d):
    return I.products(spark, d, "metadata").select("product_id", T.safe_slug("details.product_display_name").alias("slug"))


@query
def flatten_attrs(spark, d):
    return I.products(spark, d, "metadata").select("product_id", F.array_join(T.flatten_attributes("details.article_attributes"), "|").alias("attributes"))


@query
def canonical_text(spark, d):
    return I.products(spark, d, "metadata", "categories").select("product_id", T.canonical_text(I.canonical_parts(), "details.article_attributes").alias("canonical_text"))


@query
def category_map(spark, d):
    kept = T.category_map({c: F.element_at("categories", F.lit(c)) for c in ("gender", "masterCategory", "articleType", "year")})
    return I.products(spark, d, "categories").select("product_id", F.explode(kept).alias("category", "value"))


@query
def quality_flags(spark, d):
    return I.products(spark, d, "image_path", "metadata").select("product_id", F.col("image_path").isNotNull().alias("has_image"), (F.length(T.normalize_value("details.description")) > 0).alias("has_description"))


# Text index


@query
def split_chunks(spark, d):
    return X.split_chunks(I.products(spark, d, "canonical_text"), "product_id", "canonical_text")


@query
def tokenize(spark, d):
    return X.tokenized(I.chunks(spark, d)).select("chunk_id", F.posexplode("tokens").alias("position", "token"))


@query
def stopwords(spark, d):
    return X.tokenized(I.chunks(spark, d), stopwords=True).select("chunk_id", F.posexplode("tokens").alias("position", "token"))


@query
def porter_stem(spark, d):
    terms = X.tokenized(I.chunks(spark, d), stopwords=True).select(F.explode("tokens").alias("term")).distinct()
    return terms.select("term", T.porter_stem("term").alias("stem"))


@query
def term_counts(spark, d):
    return X.term_counts(X.tokenized(I.chunks(spark, d), stopwords=True)).select("chunk_id", "term", "n")


@query
def text_codebook(spark, d):
    return I.codebook(spark, d).select("term", "tf", "df", F.round("idf", 6).alias("idf"), "position")


@query
def tfidf_vectors(spark, d):
    return I.postings(spark, d).select("chunk_id", "term", F.round("weight", 6).alias("weight"))


@query
def text_postings(spark, d):
    return I.postings(spark, d).select("term", "chunk_id", "product_id", F.round("weight", 6).alias("weight"))


@query
def text_index_summary(spark, d):
    return X.index_summary(I.chunks(spark, d), I.postings(spark, d))


@query
def vector_from_postings(spark, d):
    maps = X.vector_map(I.postings(spark, d))
    return maps.select("chunk_id", F.size("vector").cast("long").alias("n_terms"), F.round(F.array_max(F.map_values("vector")), 6).alias("largest"))


@query
def chunk_products(spark, d):
    """The product that a chunk's id names."""
    return I.chunks(spark, d).select("chunk_id", T.chunk_product("chunk_id").alias("product_id"))


@query
def lexeme_postings(spark, d):
    return X.lexemes(I.products(spark, d, "canonical_text").select("product_id", F.col("canonical_text").alias("text"))).select("product_id", "term", "n")


@query
def fts_members(spark, d):
    """Full-text rank over stored lexeme postings, within the train split of the full scale."""
    path = scratch_path(spark, "lexemes")
    lexeme_postings(spark, d).write.parquet(path)
    members = I.members(spark, d).where("scale = 'full' AND split = 'train'").select("product_id")
    found = cut(X.lexeme_rank(fts_asked(spark, d), spark.read.parquet(path), members))
    remove_path(spark, path)
    return found.select("query_id", "product_id", "score", "rank")


@query
def stored_text_search(spark, d):
    """``text_search`` over codebook and postings written and read back."""
    path = scratch_path(spark, "text-index")
    artifacts.save_table(I.codebook(spark, d), f"{path}/codebook")
    book = artifacts.load_table(spark, f"{path}/codebook")
    artifacts.save_postings(X.tfidf(X.tokenized(I.chunks(spark, d), stopwords=True), book), f"{path}/postings", "text", "full", "term", "chunk_id")
    posted = artifacts.load_postings(spark, f"{path}/postings", "text", "full").select(F.col("item_id").alias("chunk_id"), "product_id", F.col("codeword_id").alias("term"), "weight")
    found = cut(X.search(I.query_vectors(I.asked(spark, d), book), posted, 10))
    remove_path(spark, path)
    return found.select("query_id", "product_id", "score", "chunk_id", "rank")


@query
def stored_visual_search(spark, d):
    """``visual_search`` over postings written and read back."""
    path = scratch_path(spark, "visual-index")
    rows = V.unit_histograms(I.vectors(spark, d)).withColumnRenamed("id", "product_id")
    artifacts.save_postings(rows.withColumn("item", F.col("product_id")), f"{path}/postings", "image", "full", "word_id", "item")
    posted = artifacts.load_postings(spark, f"{path}/postings", "image", "full").select(F.col("codeword_id").cast("int").alias("word_id"), "product_id", "weight")
    asked = posted.where("product_id % 20 = 0").select(F.col("product_id").alias("query_id"), F.col("product_id").alias("exclude_id"), "word_id", "weight")
    found = cut(V.visual_search(asked, posted))
    remove_path(spark, path)
    return found.select("query_id", "product_id", "score", "rank")


def text_top(spark, d, k):
    book = cut(I.codebook(spark, d))
    held = X.vectors(X.tokenized(I.chunks(spark, d), stopwords=True), book, "chunk_id", "product_id").withColumnRenamed("chunk_id", "item")
    asked = X.vectors(I.asked(spark, d).withColumn("tokens", T.without_stopwords(T.tokens("text"))), book, "query_id", "exclude_id")
    return X.search_vectors(asked, held, k)


@query
def text_search(spark, d):
    return text_top(spark, d, 10).select("query_id", "product_id", "score", "chunk_id", "rank")


@query
def best_chunk(spark, d):
    """The best chunk of every product that a query returned."""
    book = cut(I.codebook(spark, d))
    posted = X.tfidf(X.tokenized(I.chunks(spark, d), stopwords=True), book)
    asked = table(spark, d, "search_queries").where("modality = 'multimodal'").select("query_id", F.lit(None).cast("long").alias("exclude_id"), "text")
    pairs = table(spark, d, "search_results").select("query_id", "product_id").distinct()
    wanted = pairs.join(I.query_vectors(asked, book).select("query_id", "term", F.col("weight").alias("asked")), "query_id")
    scored = wanted.join(posted, ["product_id", "term"]).groupBy("query_id", "product_id", "chunk_id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), 6).alias("score"))
    best = scored.groupBy("query_id", "product_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "chunk_id")).alias("b"))
    return best.select("query_id", "product_id", (-F.col("b.low")).alias("score"), "b.chunk_id")


def fts_asked(spark, d):
    return table(spark, d, "search_queries").where("modality = 'multimodal'").select("query_id", F.col("product_id").alias("exclude_id"), "text")


@query
def fts_rank(spark, d):
    asked = fts_asked(spark, d)
    held = I.products(spark, d, "canonical_text").select("product_id", F.col("canonical_text").alias("text"))
    return X.fts_rank(asked, held).select("query_id", "product_id", "score", "rank")


@query
def pairwise_cosine(spark, d):
    """Neighbouring chunks of each product against each other."""
    rows = I.chunks(spark, d).select("chunk_id", "product_id", "position")
    pairs = rows.join(rows.select(F.col("chunk_id").alias("b"), "product_id", (F.col("position") - 1).alias("position")), ["product_id", "position"]).select(F.col("chunk_id").alias("a"), "b")
    long = I.postings(spark, d).select(F.col("chunk_id").alias("id"), F.col("term").alias("word"), "weight")
    return V.sparse_cosine(long, long, pairs)


# Vectors and the visual index


def embedded(spark, d):
    rows = I.embeddings(spark, d)
    return rows, rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("exclude_id"), "vector")


@query
def exact_search(spark, d):
    return V.exact_search(*embedded(spark, d))


def visual_queries(rows):
    return rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("exclude_id"), "vector")


@query
def exact_search_filtered(spark, d):
    rows = cut(I.vectors(spark, d))
    members = I.members(spark, d).where("scale = '10k'").select(F.col("product_id").alias("id"))
    return V.exact_search(rows.join(members, "id", "left_semi"), visual_queries(rows))


@query
def ann_search(spark, d):
    """Cells around the class means; each query visits the nearest four, then all that its k-th neighbour does not rule out."""
    rows, asked = embedded(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return V.ivf_search(rows, asked, V.class_means(rows.join(labels, "id")), probes=4)


@query
def dense_to_sparse(spark, d):
    return V.sparse(I.vectors(spark, d), "id", "vector").select(F.col("id").alias("product_id"), "word_id", "weight")


@query
def visual_rows(spark, d):
    """Histogram rows as they are stored: an id of modality, scale and product, words that aren't 0 by name."""
    words = V.sparse(I.vectors(spark, d), "id", "vector").groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("word_id").cast("string"), "weight")))).alias("words"))
    placed = I.members(spark, d).select("scale", F.col("product_id").alias("id")).join(words, "id")
    return placed.select(F.concat_ws(":", F.lit("image"), "scale", "id").alias("row_id"), F.col("id").alias("product_id"), F.size("words").cast("long").alias("words"), F.round(F.array_max(F.map_values("words")), 6).alias("largest"))


@query
def visual_postings(spark, d):
    return V.unit_histograms(I.vectors(spark, d)).select("word_id", F.col("id").alias("product_id"), F.round("weight", 6).alias("weight"))


@query
def visual_index_summary(spark, d):
    return V.index_summary(I.vectors(spark, d), V.unit_histograms(I.vectors(spark, d)))


def visual_top(spark, d, k):
    units = cut(I.unit_words(spark, d))
    asked = units.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("exclude_id"), "words", "weights")
    return V.search_histograms(asked, units, k)


@query
def visual_search(spark, d):
    return visual_top(spark, d, 10).select("query_id", "product_id", "score", "rank")


def codewords(spark, d):
    rows = I.embeddings(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return V.assign(rows, V.class_means(rows.join(labels, "id")))


@query
def assign_codewords(spark, d):
    return codewords(spark, d).select(F.col("id").alias("vec_id"), "word_id")


@query
def visual_histogram(spark, d):
    rows = V.histograms(codewords(spark, d).select((F.col("id") % 50).alias("item"), "word_id"))
    return rows.select("item", "word_id", "n", F.round("weight", 6).alias("weight"))


@query
def sample_descriptors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("item"))
    return V.sample_descriptors(rows, "item", "vec_id", 200).select("item", "vec_id")


@query
def kmeans_codebook(spark, d):
    return V.fit_codebook(I.embeddings(spark, d), 16)


# Rankings and fusion


@query
def batch_topk(spark, d):
    rows = I.rankings(spark, d).select(F.struct("query_id", "modality").alias("q"), "product_id", F.round("score", 6).alias("score"))
    return X.top_k(rows, 5, "q").select("q.query_id", "q.modality", "product_id", "rank")


@query
def max_normalize(spark, d):
    return fusion.max_normalized(I.rankings(spark, d)).select("query_id", "product_id", "modality", F.round("score", 6).alias("score"))


def fused(spark, d):
    return fusion.fuse(I.rankings(spark, d), WEIGHTS)


@query
def fusion_(spark, d):
    return fused(spark, d).select("query_id", "product_id", "score", "text_score", "image_score", "rank")


QUERIES["fusion"] = QUERIES.pop("fusion_")


@query
def enrich(spark, d):
    return fusion.enrich(fused(spark, d), I.names(spark, d)).select("query_id", "product_id", "score", "rank", "display_name")


@query
def result_summary(spark, d):
    return fusion.summary(fusion.enrich(fused(spark, d), I.names(spark, d)))


@query
def union_ids(spark, d):
    return I.rankings(spark, d).select("query_id", "product_id").distinct()


def ranked(spark, d):
    """(query_id, product_id, engine, rank) of each modality and of the fusion."""
    own = I.rankings(spark, d).select(F.struct("query_id", "modality").alias("q"), "product_id", F.round("score", 6).alias("score"))
    single = X.top_k(own, 10, "q").select("q.query_id", "product_id", F.col("q.modality").alias("engine"), "rank")
    return single.unionByName(fused(spark, d).select("query_id", "product_id", F.lit("fused").alias("engine"), "rank"))


@query
def topk_overlap(spark, d):
    rows = ranked(spark, d)
    text, image = (rows.where(F.col("engine") == e).select("query_id", "product_id") for e in ("text", "image"))
    return text.join(image, ["query_id", "product_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))


@query
def app_visual_search(spark, d):
    rows = cut(I.vectors(spark, d))
    return fusion.enrich(V.exact_search(rows, visual_queries(rows)), I.names(spark, d)).select("query_id", "product_id", "score", "rank", "display_name")


@query
def app_recommend(spark, d):
    """Five times as many candidates of each modality as are asked for, fused, with their names."""
    candidates = text_top(spark, d, 50).select("query_id", "product_id", "score", F.lit("text").alias("modality")).unionByName(visual_top(spark, d, 50).select("query_id", "product_id", "score", F.lit("image").alias("modality")))
    best = fusion.fuse(candidates, WEIGHTS)
    return fusion.enrich(best, I.names(spark, d)).select("query_id", "product_id", "score", "text_score", "image_score", "rank", "display_name")


# Partitions


@query
def stratified_order(spark, d):
    return partition.round_robin(partition.groups(I.partition_input(spark, d))).select("group_id", "stratum", "size", "turn")


@query
def partition_select(spark, d):
    dealt = partition.round_robin(partition.groups(I.partition_input(spark, d)))
    return partition.select(dealt, 100).select("group_id", "before")


@query
def partition_split(spark, d):
    return partition.memberships(I.partition_input(spark, d), {"1k": 1_000, "10k": 10_000, "full": None}, {"train": 0.8, "validation": 0.1, "test": 0.1})


@query
def partition_balance(spark, d):
    """What holds of ``partition_split``: products per scale, groups in two splits, and whether the train share is near 0.8."""
    rows = cut(partition_split(spark, d))
    group = F.coalesce("image_group", F.concat(F.lit("product:"), F.col("product_id"))).alias("group_id")
    placed = rows.join(I.partition_input(spark, d).select("product_id", group), "product_id")
    parted = placed.groupBy("scale", "group_id").agg((F.min("split") < F.max("split")).cast("long").alias("parted")).groupBy("scale").agg(F.sum("parted").alias("parted_groups"))
    shares = rows.groupBy("scale").agg(F.count(F.lit(1)).alias("products"), F.countDistinct("product_id").alias("distinct_products"), (F.abs(F.avg((F.col("split") == "train").cast("double")) - 0.8) < 0.05).alias("near_share"))
    return shares.join(parted, "scale").select("scale", "products", "distinct_products", "parted_groups", "near_share")


@query
def manifest_members(spark, d):
    """Memberships written as manifests and read back; of a product in two splits the last by name stands."""
    path = scratch_path(spark, "manifest")
    artifacts.save_manifest(I.members(spark, d), path)
    back = cut(artifacts.load_manifest(spark, path).select("scale", F.explode("splits").alias("split", "ids")).select("scale", "split", F.explode("ids").alias("product_id")))
    remove_path(spark, path)
    return back


@query
def scale_members(spark, d):
    return I.members(spark, d).join(I.products(spark, d).select("product_id"), "product_id", "left_semi").select("scale", "split", "product_id")


# Evaluation


@query
def test_queries(spark, d):
    """The first 25 by id: a fixed set of queries is the feature."""
    test = I.members(spark, d).where("scale = 'full' AND split = 'test'").select("product_id")
    return I.products(spark, d, "canonical_text", "has_image").where("has_image AND trim(canonical_text) <> ''").join(test, "product_id", "left_semi").select("product_id", "canonical_text").orderBy("product_id").limit(25)


@query
def relevance_pairs(spark, d):
    """The relevant products of each are those of its class: one row per product, with how many they are."""
    rows = I.types(spark, d)
    sizes = rows.where("type IS NOT NULL").groupBy("type").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    return rows.join(sizes, "type", "left").select("product_id", "type", F.coalesce("relevant", F.lit(0)).cast("long").alias("relevant"))


def typed_queries(spark, d):
    rows = table(spark, d, "search_queries").where("modality = 'multimodal'").select("query_id", "product_id").distinct()
    return rows.join(I.types(spark, d), "product_id", "left").select("query_id", "type")


@query
def precision_at_k(spark, d):
    return metrics.precision_at_k(ranked(spark, d).where("engine = 'fused'"), I.types(spark, d), typed_queries(spark, d))


@query
def recall_at_k(spark, d):
    rows = cut(ranked(spark, d))
    return metrics.recall_at_k(rows.where("engine = 'text'"), rows.where("engine = 'fused'"), typed_queries(spark, d))


@query
def quality_report(spark, d):
    rows, asked, kinds = cut(ranked(spark, d)), cut(typed_queries(spark, d)), cut(I.types(spark, d))
    out = None
    for engine in ("text", "image", "fused"):
        own = rows.where(F.col("engine") == engine)
        both = metrics.precision_at_k(own, kinds, asked).join(metrics.recall_at_k(own, rows.where("engine = 'fused'"), asked), "query_id").withColumn("engine", F.lit(engine))
        out = both if out is None else out.unionByName(both)
    return out.groupBy("engine").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


@query
def latency_summary(spark, d):
    return metrics.latency_summary(table(spark, d, "events"), "event_type", "value")


@query
def tradeoffs(spark, d):
    return metrics.tradeoffs(latency_summary(spark, d), ["mean", "p95"], ["n"], "event_type")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.SQL.items() if k in QUERIES}

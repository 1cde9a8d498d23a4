"""The queries of the training-data operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import knn, mixing, neardup, outrank, overlap, pii, splits, terms, tokens
from weftwork.plans.sql import SPLIT
from weftwork.storage import cut, table

DIM = 512


# 1: the most similar vectors of every vector


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "search_queries").where("modality = 'image' AND product_id IS NOT NULL").select("product_id")
    found = knn.neighbours(table(spark, d, "products"), "product_id", "visual_vector", DIM, 10, asked, "ingested_at")
    return found.select(F.col("query").alias("product_id"), F.col("id").alias("neighbour_id"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Asks for every product whose id is divisible by 20, against all products."""
    products = table(spark, d, "products")
    asked = products.select("product_id").where("product_id % 20 = 0")
    found = knn.neighbours(products, "product_id", "visual_vector", DIM, 10, asked, "ingested_at")
    return found.select(F.col("query").alias("product_id"), F.col("id").alias("neighbour_id"), F.col("place").cast("long").alias("place"), F.round("similarity", 5).alias("similarity"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """How hashing alone does against brute force, for every product whose id is divisible by 20."""
    products = table(spark, d, "products")
    return knn.recall_report(products, "product_id", "visual_vector", DIM, 10, products.select("product_id").where("product_id % 20 = 0"), "ingested_at")


# 2: frequency of every term


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.frequencies(table(spark, d, "chunks"), "chunk_id", "content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("mark IS NOT NULL").select("term", "mark")


P2_TERMS = r"""
WITH chunk AS (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_id IS NOT NULL AND trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
found AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS term FROM chunk),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM found GROUP BY term)
SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM chunk) THEN 'common' END AS mark FROM counted
"""


# 3: splits that keep related records together


def image_edges(spark: SparkSession, d: str) -> DataFrame:
    """(record, entity): a product and the digest of its image file."""
    return table(spark, d, "products").select(F.col("product_id").alias("record"), splits.digest("duplicate_image_group").alias("entity")).dropna().distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    member = overlap.memberships(table(spark, d, "dataset_memberships")).select(F.col("scale").alias("part"), "split", "id")
    return splits.leaks(image_edges(spark, d), member).select(F.col("part").alias("scale"), F.col("entity").alias("image_group"))


def p3_assigned(spark: SparkSession, d: str) -> DataFrame:
    member = overlap.memberships(table(spark, d, "dataset_memberships")).select(F.col("scale").alias("part"), "id").distinct()
    products = table(spark, d, "products").select(F.col("product_id").alias("id"), F.element_at("categories", F.lit("masterCategory")).alias("label"))
    label = products.groupBy("id").agg(F.max("label").alias("label"))
    return splits.assign(member.join(label, "id", "left"), image_edges(spark, d))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return p3_assigned(spark, d).select(F.col("part").alias("scale"), F.col("id").alias("product_id"), "split")


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    """Products per scale, master category and split, beside what the target proportions ask for."""
    by = p3_assigned(spark, d).groupBy(F.col("part").alias("scale"), F.coalesce("label", F.lit("")).alias("master_category"))
    return by.agg(F.count(F.lit(1)).alias("products"), *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits.NAMES])


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of ``p3_splits``: products per scale, image groups in two splits, and each split's size, which may
    miss its share by one product per label (shares are rounded within labels) and by the largest component."""
    placed = cut(p3_assigned(spark, d))
    parted = splits.leaks(image_edges(spark, d), placed.select("part", "id", "split")).groupBy("part").agg(F.count(F.lit(1)).alias("parted"))
    largest = placed.groupBy("part", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.max("n").alias("largest"))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("products"), F.countDistinct(F.coalesce("label", F.lit(""))).alias("labels"), *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits.NAMES])
    near = [(F.abs(F.col(s) - r * F.col("products")) <= F.col("labels") + F.col("largest")).alias(f"{s}_near") for s, r in zip(splits.NAMES, splits.RATIOS)]
    return sizes.join(largest, "part").join(parted, "part", "left").select(F.col("part").alias("scale"), "products", F.coalesce("parted", F.lit(0)).cast("long").alias("parted_groups"), *near)


P3_FOUND = rf"""
WITH grouped AS (SELECT DISTINCT product_id, regexp_extract(lower(duplicate_image_group), '[0-9a-f]{{64}}') AS image_group FROM products),
member AS (SELECT DISTINCT scale, product_id, {SPLIT} AS split FROM dataset_memberships WHERE {SPLIT} IS NOT NULL)
SELECT scale, image_group FROM grouped JOIN member USING (product_id) WHERE image_group <> '' GROUP BY scale, image_group HAVING count(DISTINCT split) > 1
"""


# 4: one ranking from several scores


def result_scores() -> dict:
    """The four scores of a search result row; clicks and rank_cd stand in the metadata in several shapes."""

    def inside(name: str):
        return F.coalesce(*[outrank.number(F.get_json_object("metadata", path)) for path in (f"$.modality_scores.{name}", f"$.{name}")])

    score = F.col("score").cast("double")
    return {"text": F.when(F.col("modality") == "text", score), "image": F.when(F.col("modality") == "image", score), "rank_cd": inside("rank_cd"), "clicks": inside("clicks")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return outrank.undefeated(table(spark, d, "search_results"), "query_id", "product_id", result_scores())


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = outrank.ranking(table(spark, d, "search_results"), "query_id", "product_id", result_scores())
    return ranked.select("query_id", "product_id", "position", F.round("net_flow", 6).alias("net_flow"))


P3_CHECK = f"SELECT scale, count(DISTINCT product_id) AS products, 0 AS parted_groups, true AS train_near, true AS validation_near, true AS test_near FROM dataset_memberships WHERE scale IS NOT NULL AND product_id IS NOT NULL AND {SPLIT} IS NOT NULL GROUP BY scale"
P4_ITEMS = r"""
WITH raw AS (SELECT query_id, product_id, modality, CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
  coalesce(TRY_CAST(json_extract_string(metadata, '$.modality_scores.rank_cd') AS DOUBLE), TRY_CAST(json_extract_string(metadata, '$.rank_cd') AS DOUBLE)) AS rank_cd,
  coalesce(TRY_CAST(json_extract_string(metadata, '$.modality_scores.clicks') AS DOUBLE), TRY_CAST(json_extract_string(metadata, '$.clicks') AS DOUBLE)) AS clicks FROM search_results),
item AS (SELECT query_id, product_id, coalesce(max(CASE WHEN modality = 'text' THEN score END), '-infinity'::DOUBLE) AS s0, coalesce(max(CASE WHEN modality = 'image' THEN score END), '-infinity'::DOUBLE) AS s1,
  coalesce(max(rank_cd), '-infinity'::DOUBLE) AS s2, coalesce(max(clicks), '-infinity'::DOUBLE) AS s3 FROM raw GROUP BY query_id, product_id)
"""
P4_FOUND = (
    P4_ITEMS
    + """
SELECT query_id, product_id FROM item a WHERE NOT EXISTS (SELECT 1 FROM item b WHERE b.query_id = a.query_id AND b.product_id <> a.product_id
  AND sign((a.s0 > b.s0)::INT - (a.s0 < b.s0)::INT + (a.s1 > b.s1)::INT - (a.s1 < b.s1)::INT + (a.s2 > b.s2)::INT - (a.s2 < b.s2)::INT + (a.s3 > b.s3)::INT - (a.s3 < b.s3)::INT) < 1)
"""
)
P4_RANKING = (
    P4_ITEMS
    + """
, long AS (UNPIVOT item ON s0, s1, s2, s3 INTO NAME s VALUE v),
n AS (SELECT query_id, count(*) AS n FROM item GROUP BY query_id),
pct AS (SELECT query_id, product_id, s, n, (rank() OVER w - 1 + (count(*) OVER (PARTITION BY query_id, s, v) - 1) / 2.0) / greatest(n - 1, 1) AS x FROM long JOIN n USING (query_id) WINDOW w AS (PARTITION BY query_id, s ORDER BY v)),
pair AS (SELECT a.query_id, a.product_id, a.n, least(greatest((a.x - b.x - 0.02) / 0.23, 0), 1) - least(greatest((b.x - a.x - 0.02) / 0.23, 0), 1) AS f FROM pct a JOIN pct b ON a.query_id = b.query_id AND a.s = b.s),
flow AS (SELECT query_id, product_id, round(sum(f) / 4 / greatest(max(n) - 1, 1), 6) + 0.0 AS net_flow FROM pair GROUP BY query_id, product_id)
SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY net_flow DESC, product_id) AS position, net_flow FROM flow
"""
)


# 5 and 6: overlaps across splits, near-duplicates


def p6_near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_classes(table(spark, d, "products"), "product_id", "canonical_text", 0.7, order="ingested_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(*p6_near(spark, d)).select(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(*p6_near(spark, d)).select(F.col("id").alias("product_id"), "class_id", "group_id", "links")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    member = overlap.memberships(table(spark, d, "dataset_memberships"))
    return overlap.cross_split_pairs(table(spark, d, "products"), "product_id", "canonical_text", member, 0.7, order="ingested_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("scale", "split", F.least("train_id", "id").alias("product_id_a"), F.greatest("train_id", "id").alias("product_id_b")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation products that stand in train, and the pairs, per scale, split and master category."""
    label = table(spark, d, "products").groupBy(F.col("product_id").alias("id")).agg(F.max(F.element_at("categories", F.lit("masterCategory"))).alias("master_category"))
    per_product = p5_pairs(spark, d).groupBy("scale", "split", "id").agg(F.count(F.lit(1)).alias("pairs")).join(label, "id", "left")
    return per_product.groupBy("scale", "split", F.coalesce("master_category", F.lit("")).alias("master_category")).agg(F.count(F.lit(1)).alias("products"), F.sum("pairs").alias("pairs"))


P6_PAIRS = r"""
WITH word AS (SELECT DISTINCT product_id, unnest(regexp_extract_all(lower(canonical_text), '[a-z0-9]+')) AS w FROM products),
size AS (SELECT product_id, count(*) AS n FROM word GROUP BY product_id),
met AS (SELECT a.product_id AS product_id_a, b.product_id AS product_id_b, count(*) AS n FROM word a JOIN word b ON a.w = b.w AND a.product_id < b.product_id GROUP BY 1, 2),
near AS (SELECT product_id_a, product_id_b FROM met JOIN size a ON a.product_id = product_id_a JOIN size b ON b.product_id = product_id_b WHERE met.n / (a.n + b.n - met.n) >= 0.7)
"""
P6_FOUND = P6_PAIRS + "SELECT * FROM near"
P5_MEMBER = rf"""
, member AS (SELECT DISTINCT scale, product_id, {SPLIT} AS split FROM dataset_memberships WHERE {SPLIT} IS NOT NULL)
"""
P5_FOUND = (
    P6_PAIRS
    + P5_MEMBER
    + """
SELECT scale, CASE WHEN a.split = 'train' THEN b.split ELSE a.split END AS split, product_id_a, product_id_b FROM near JOIN member a ON a.product_id = product_id_a JOIN member b USING (scale)
WHERE b.product_id = product_id_b AND (a.split = 'train') <> (b.split = 'train')
"""
)
P5_REPORT = (
    P6_PAIRS
    + P5_MEMBER
    + """
, two AS (SELECT product_id_a AS t, product_id_b AS e FROM near UNION ALL SELECT product_id_b, product_id_a FROM near),
hit AS (SELECT m.scale, m.split, e, count(*) AS pairs FROM two JOIN member m ON m.product_id = e AND m.split <> 'train' JOIN member t ON t.product_id = two.t AND t.scale = m.scale AND t.split = 'train' GROUP BY 1, 2, 3),
label AS (SELECT product_id, coalesce(max(categories['masterCategory']), '') AS master_category FROM products GROUP BY product_id)
SELECT scale, split, master_category, count(*) AS products, sum(pairs)::BIGINT AS pairs FROM hit JOIN label ON product_id = e GROUP BY ALL
"""
)
P6_GROUPS = (
    "WITH RECURSIVE "
    + P6_PAIRS.strip().removeprefix("WITH ")
    + """
, text AS (SELECT product_id, list_sort(list(w)) AS words FROM word GROUP BY product_id),
class AS (SELECT product_id, min(product_id) OVER (PARTITION BY words) AS class_id FROM text),
link AS (SELECT product_id_a AS x, product_id_b AS y FROM near UNION SELECT product_id_b, product_id_a FROM near),
reach AS (SELECT product_id, product_id AS node FROM text UNION SELECT reach.product_id, link.y FROM reach JOIN link ON link.x = reach.node),
grouped AS (SELECT product_id, min(node) AS group_id FROM reach GROUP BY product_id),
degree AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM link JOIN class a ON a.product_id = x JOIN class b ON b.product_id = y WHERE a.class_id <> b.class_id GROUP BY a.class_id)
SELECT product_id, class.class_id, group_id, coalesce(links, 0) AS links FROM class JOIN grouped USING (product_id) LEFT JOIN degree ON degree.class_id = class.class_id
"""
)


# 7: encoding with a public tokenizer


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """For each token its characters in the text."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text", spans=True).select("doc_id", "starts", "ends")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return tokens.decode(tokens.encode(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")


P7_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


# 8: mixing sources to target weights


def p8_mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized(table(spark, d, "documents"), "doc_id", "text", "source"), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_mixed(spark, d)[1].where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return p8_mixed(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix: of each source whether a document goes beyond max_repeats, whether reached tokens are those
    of the chosen documents, and whether a source gives what it should: its share if it can, else all it has."""
    chosen, shares = p8_mixed(spark, d)
    got = chosen.groupBy("source").agg(F.max("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    full = F.when(F.col("short"), F.col("mixed_tokens") == F.col("own_tokens") * F.col("max_repeats")).otherwise(F.abs(F.col("mixed_tokens") - F.col("wanted_tokens")) <= 0.02 * F.col("wanted_tokens"))
    return shares.join(got, "source", "left").select("source", (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.coalesce("tokens", F.lit(0)) == F.col("mixed_tokens")).alias("adds_up"), full.alias("gives_enough"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return p8_mixed(spark, d)[0].where("copies > 0").select(F.col("id").alias("doc_id"), "source", "copies")


# 9: personal information inside free text


def p9_tagged(spark: SparkSession, d: str) -> DataFrame:
    return pii.tagged(spark, table(spark, d, "documents"), table(spark, d, "given_names"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.pieces(p9_tagged(spark, d), "doc_id")


def p9_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    return pii.replaced(p9_tagged(spark, d), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_terms, p3_found, p3_splits, p3_balance, p3_check, p4_found, p4_ranking, p5_found, p5_report, p6_found, p6_groups, p7_ids, p7_spans, p7_decoded, p8_found, p8_shares, p8_check, p8_mix, p9_found, p9_replaced)
}
SQL = {
    "p2_terms": P2_TERMS,
    "p2_found": f"SELECT term, mark FROM ({P2_TERMS}) WHERE mark IS NOT NULL",
    "p3_found": P3_FOUND,
    "p3_check": P3_CHECK,
    "p4_found": P4_FOUND,
    "p4_ranking": P4_RANKING,
    "p5_found": P5_FOUND,
    "p5_report": P5_REPORT,
    "p6_found": P6_FOUND,
    "p6_groups": P6_GROUPS,
    "p7_decoded": P7_DECODED,
    "p8_check": "SELECT DISTINCT lower(trim(source)) AS source, true AS within_repeats, true AS adds_up, true AS gives_enough FROM source_targets",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

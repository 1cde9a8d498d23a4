"""The same queries in SQL, for comparison."""

from __future__ import annotations

from weftwork.functions.text import NOTHING, SPLITS, STOPWORDS

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def value(x: str) -> str:
    return f"(CASE WHEN list_contains({words(NOTHING)}, lower(coalesce({ws(x)}, ''))) THEN '' ELSE {ws(x)} END)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')"


def kept(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: NOT list_contains({words(STOPWORDS)}, t))"


P = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ingested_at DESC) AS rn FROM products WHERE product_id IS NOT NULL) WHERE rn = 1)"
C = "c AS (SELECT DISTINCT chunk_id, product_id, position, content FROM chunks WHERE modality = 'text')"
SPLIT = "CASE " + " ".join(f"WHEN {ws('lower(split)')} IN ({', '.join(repr(k) for k, v in SPLITS.items() if v == name)}) THEN '{name}'" for name in ("train", "validation", "test")) + " END"
M = f"m AS (SELECT DISTINCT scale, product_id, {SPLIT} AS split FROM dataset_memberships WHERE {SPLIT} IS NOT NULL)"
CNT = f"cnt AS (SELECT chunk_id, product_id, term, count(*) AS n FROM (SELECT chunk_id, product_id, unnest({kept('content')}) AS term FROM c) GROUP BY ALL)"
TR = "tr AS (SELECT chunk_id FROM c WHERE product_id IN (SELECT product_id FROM m WHERE scale = 'full' AND split = 'train'))"
BOOK = "book AS (SELECT *, ln((1 + (SELECT count(*) FROM tr)) / (1 + df)) + 1 AS idf FROM (SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM cnt WHERE chunk_id IN (SELECT chunk_id FROM tr) GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 5000))"
POST = "post AS (SELECT chunk_id, product_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY chunk_id)) AS weight FROM (SELECT chunk_id, product_id, term, (1 + ln(n)) * idf AS raw FROM cnt JOIN book USING (term)))"
INDEX = f"WITH {P}, {M}, {C}, {CNT}, {TR}, {BOOK}, {POST}"


def qvec(source: str) -> str:
    """Query vectors of a relation (query_id, text)."""
    return f"""qcnt AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest({kept('text')}) AS term FROM ({source})) GROUP BY ALL),
qv AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS weight FROM (SELECT query_id, term, (1 + ln(n)) * idf AS raw FROM qcnt JOIN book USING (term)))"""


ASKED = "SELECT product_id AS query_id, canonical_text AS text FROM p WHERE product_id % 20 = 0"
CHUNK_SCORE = "cs AS (SELECT query_id, product_id, chunk_id, round(sum(qv.weight * post.weight), 6) AS score FROM qv JOIN post USING (term) WHERE query_id <> product_id GROUP BY ALL)"
TEXT_TOP = "tt AS (SELECT query_id, product_id, score, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT query_id, product_id, max(score) AS score, arg_max(chunk_id, (score, -row)) AS chunk_id FROM (SELECT *, row_number() OVER (ORDER BY chunk_id) AS row FROM cs) GROUP BY ALL))"
VEC = "v AS (SELECT product_id, visual_vector::DOUBLE[] AS v FROM p WHERE len(visual_vector) = 512 AND list_sum(list_transform(visual_vector::DOUBLE[], lambda x: x * x)) > 0)"
EXACT_TOP = "et AS (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT q.product_id AS query_id, r.product_id, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM v q JOIN v r ON q.product_id % 20 = 0 AND q.product_id <> r.product_id))"
UNIT = "u AS (SELECT product_id, word_id, weight / sqrt(sum(weight * weight) OVER (PARTITION BY product_id)) AS weight FROM (SELECT product_id, generate_subscripts(v, 1) - 1 AS word_id, unnest(v) AS weight FROM v) WHERE weight <> 0)"
VISUAL_TOP = "vt AS (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT q.product_id AS query_id, r.product_id, round(sum(q.weight * r.weight), 6) AS score FROM u q JOIN u r USING (word_id) WHERE q.product_id % 20 = 0 AND q.product_id <> r.product_id GROUP BY ALL))"
RANKED = "r AS (SELECT query_id, product_id, modality, max(score) AS score FROM search_results WHERE NOT isnan(score) GROUP BY ALL)"
NORM = "n AS (SELECT query_id, product_id, modality, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS score FROM r WINDOW w AS (PARTITION BY query_id, modality))"
FUSED = "f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT query_id, product_id, round(0.45 * coalesce(max(CASE WHEN modality = 'text' THEN score END), 0) + 0.55 * coalesce(max(CASE WHEN modality = 'image' THEN score END), 0), 6) AS score, round(coalesce(max(CASE WHEN modality = 'text' THEN score END), 0), 6) AS text_score, round(coalesce(max(CASE WHEN modality = 'image' THEN score END), 0), 6) AS image_score FROM n GROUP BY ALL))"
NAMES = "nm AS (SELECT product_id, json_extract_string(metadata, '$.product_display_name') AS display_name FROM p)"
TYPES = "ty AS (SELECT product_id, categories['articleType'] AS type FROM p)"
GROUPED = "g AS (SELECT coalesce(nullif(regexp_extract(lower(duplicate_image_group), '[0-9a-f]{64}'), ''), 'product:' || product_id) AS group_id, product_id, coalesce(categories['masterCategory'], 'Unknown') AS stratum FROM p), gr AS (SELECT group_id, count(*) AS size, arg_min(stratum, product_id) AS stratum, sha256('42:' || group_id) AS draw FROM g GROUP BY group_id), dealt AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw) AS turn FROM gr)"
MEANS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), lx AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), mean AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM lx GROUP BY ALL) GROUP BY label), near AS (SELECT vec_id, arg_min(label, (d, label)) AS word_id FROM (SELECT vec_id, mean.label AS label, round(list_sum(list_transform(m, lambda x: x * x)) - 2 * list_inner_product(v, m), 12) AS d FROM e CROSS JOIN mean) GROUP BY vec_id)"
FTS = f"lex AS (SELECT product_id, term, count(*) AS n FROM (SELECT product_id, unnest({kept('canonical_text')}) AS term FROM p) GROUP BY ALL), qw AS (SELECT DISTINCT query_id, product_id AS exclude_id, unnest({kept('text')}) AS term FROM search_queries WHERE modality = 'multimodal')"
HELD_SCORE = "SELECT query_id, product_id FROM search_results WHERE modality = 'text'"
QUALITY = f"WITH {P}, {TYPES}, {RANKED}, {NORM}, {FUSED}, mr AS (SELECT query_id, product_id, modality, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(score, 6) DESC, product_id) AS rank FROM r), res AS (SELECT query_id, product_id, modality AS engine, rank FROM mr UNION ALL SELECT query_id, product_id, 'fused', rank FROM f), q AS (SELECT DISTINCT s.query_id, type FROM search_queries s LEFT JOIN ty ON ty.product_id = s.product_id WHERE modality = 'multimodal'), t10 AS (SELECT * FROM res WHERE rank <= 10), ref AS (SELECT query_id, product_id FROM t10 WHERE engine = 'fused')"
PRECISION = "prec AS (SELECT e.engine, q.query_id, round(CASE WHEN count(t10.product_id) > 0 THEN count(CASE WHEN ty.type = q.type THEN 1 END) / count(t10.product_id) ELSE 0 END, 6) AS precision FROM q CROSS JOIN (SELECT unnest(['text', 'image', 'fused']) AS engine) e LEFT JOIN t10 ON t10.query_id = q.query_id AND t10.engine = e.engine LEFT JOIN ty ON ty.product_id = t10.product_id GROUP BY ALL)"
RECALL = "rec AS (SELECT e.engine, q.query_id, round(CASE WHEN max(nref.n) > 0 THEN count(ref.product_id) / max(nref.n) WHEN count(t10.product_id) > 0 THEN 0 ELSE 1 END, 6) AS recall FROM q CROSS JOIN (SELECT unnest(['text', 'image', 'fused']) AS engine) e LEFT JOIN (SELECT query_id, count(*) AS n FROM ref GROUP BY 1) nref ON nref.query_id = q.query_id LEFT JOIN t10 ON t10.query_id = q.query_id AND t10.engine = e.engine LEFT JOIN ref ON ref.query_id = t10.query_id AND ref.product_id = t10.product_id GROUP BY ALL)"
LATENCY = "lat AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(list(value ORDER BY value)[least(count(*), greatest(1, round_even(count(*) * 0.95 + 0.5, 0)))::BIGINT], 6) AS p95, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL GROUP BY event_type)"

SQL = {
    "scan_catalog": f"WITH {P} SELECT product_id, canonical_text, image_path, has_image, has_description FROM p",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("products", "dataset_memberships", "chunks", "search_queries", "search_results", "documents", "embeddings", "events")),
    "json_path": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "product_details": f"WITH {P} SELECT product_id, json_extract_string(metadata, '$.product_display_name') AS display_name, json_extract_string(metadata, '$.brand_name') AS brand, coalesce(json_extract_string(metadata, '$.description'), '') AS description FROM p",
    "normalize_ws": f"WITH {C} SELECT chunk_id, {ws('content')} AS content FROM c",
    "normalize_value": f"WITH {P} SELECT product_id, {value('duplicate_image_group')} AS image_group, {value('json_extract_string(metadata, ''$.brand_name'')').replace(chr(39) * 2 + '$', chr(39) + '$').replace('name' + chr(39) * 2, 'name' + chr(39))} AS brand FROM p",
    "safe_slug": f"WITH {P} SELECT product_id, coalesce(nullif(trim(regexp_replace(lower(json_extract_string(metadata, '$.product_display_name')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM p",
    "quality_flags": f"WITH {P} SELECT product_id, image_path IS NOT NULL AS has_image, length({value('coalesce(json_extract_string(metadata, $$$.description$$), $$$$)')}) > 0 AS has_description FROM p",
    "split_chunks": f"""WITH {P}, w AS (SELECT product_id, string_split({ws('canonical_text')}, ' ') AS words FROM p WHERE {ws('canonical_text')} <> ''),
x AS (SELECT product_id, words, len(words) AS total_tokens, unnest(range(0, greatest(0, ceil((len(words) - 128) / 112.0))::BIGINT + 1)) AS position FROM w)
SELECT 'text:' || product_id || ':' || position AS chunk_id, product_id, position, array_to_string(words[position * 112 + 1 : position * 112 + 128], ' ') AS content, position * 112 AS start_token, least(position * 112 + 128, total_tokens) AS end_token, total_tokens FROM x""",
    "tokenize": f"WITH {C} SELECT chunk_id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS token FROM (SELECT chunk_id, {tokens('content')} AS t FROM c)",
    "stopwords": f"WITH {C} SELECT chunk_id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS token FROM (SELECT chunk_id, {kept('content')} AS t FROM c)",
    "term_counts": f"WITH {C}, {CNT} SELECT chunk_id, term, n FROM cnt",
    "text_codebook": INDEX + " SELECT term, tf, df, round(idf, 6) AS idf, row_number() OVER (ORDER BY tf DESC, term) - 1 AS position FROM book",
    "tfidf_vectors": INDEX + " SELECT chunk_id, term, round(weight, 6) AS weight FROM post",
    "text_postings": INDEX + " SELECT term, chunk_id, product_id, round(weight, 6) AS weight FROM post",
    "text_index_summary": INDEX + " SELECT (SELECT count(*) FROM c) AS chunks, count(DISTINCT term) AS terms, count(*) AS postings FROM post",
    "vector_from_postings": INDEX + " SELECT chunk_id, count(*) AS n_terms, round(max(weight), 6) AS largest FROM post GROUP BY chunk_id",
    "text_search": INDEX + f", {qvec(ASKED)}, {CHUNK_SCORE}, {TEXT_TOP} SELECT query_id, product_id, score, chunk_id, rank FROM tt WHERE rank <= 10",
    "best_chunk": INDEX + f""", {qvec("SELECT query_id, text FROM search_queries WHERE modality = 'multimodal'")}, pair AS (SELECT DISTINCT query_id, product_id FROM search_results),
ps AS (SELECT query_id, product_id, chunk_id, round(sum(qv.weight * post.weight), 6) AS score FROM pair JOIN qv USING (query_id) JOIN post USING (product_id, term) GROUP BY ALL)
SELECT query_id, product_id, score, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_id ORDER BY score DESC, chunk_id) AS k FROM ps) WHERE k = 1""",
    "fts_rank": f"WITH {P}, {FTS} SELECT query_id, product_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT query_id, product_id, round(sum(n)::DOUBLE * 0.1, 6) AS score FROM lex JOIN qw USING (term) WHERE exclude_id IS NULL OR exclude_id <> product_id GROUP BY ALL)) WHERE rank <= 10".replace("lex JOIN qw USING (term) WHERE", "(SELECT query_id, exclude_id, lex.product_id AS product_id, n FROM lex JOIN qw USING (term)) WHERE"),
    "exact_search": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT query_id, product_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS product_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10",
    "exact_search_filtered": f"WITH {P}, {M}, {VEC}, {EXACT_TOP}, k AS (SELECT * EXCLUDE rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM et WHERE product_id IN (SELECT product_id FROM m WHERE scale = '10k')) SELECT query_id, product_id, score, rank FROM k WHERE rank <= 10",
    "pairwise_cosine": INDEX + ", pair AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM c a JOIN c b ON a.product_id = b.product_id AND b.position = a.position + 1) SELECT pair.a, pair.b, round(coalesce(sum(x.weight * y.weight), 0), 6) AS similarity FROM pair LEFT JOIN post x ON x.chunk_id = pair.a LEFT JOIN post y ON y.chunk_id = pair.b AND y.term = x.term GROUP BY ALL",
    "batch_topk": f"WITH {RANKED} SELECT query_id, modality, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(score, 6) DESC, product_id) AS rank FROM r) WHERE rank <= 5",
    "max_normalize": f"WITH {RANKED}, {NORM} SELECT query_id, product_id, modality, round(score, 6) AS score FROM n",
    "fusion": f"WITH {RANKED}, {NORM}, {FUSED} SELECT query_id, product_id, score, text_score, image_score, rank FROM f WHERE rank <= 10",
    "enrich": f"WITH {P}, {NAMES}, {RANKED}, {NORM}, {FUSED} SELECT query_id, product_id, score, rank, display_name FROM f JOIN nm USING (product_id) WHERE rank <= 10",
    "result_summary": f"WITH {P}, {NAMES}, {RANKED}, {NORM}, {FUSED} SELECT query_id, rank, product_id || ' | ' || coalesce(display_name, 'unnamed') || ' | ' || printf('%.4f', round_even(score, 4)::DOUBLE) AS line FROM f JOIN nm USING (product_id) WHERE rank <= 10",
    "union_ids": f"WITH {RANKED} SELECT DISTINCT query_id, product_id FROM r",
    "topk_overlap": f"WITH {RANKED}, mr AS (SELECT query_id, product_id, modality, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(score, 6) DESC, product_id) AS rank FROM r) SELECT a.query_id, count(*) AS overlap FROM mr a JOIN mr b ON a.query_id = b.query_id AND a.product_id = b.product_id WHERE a.modality = 'text' AND b.modality = 'image' AND a.rank <= 10 AND b.rank <= 10 GROUP BY a.query_id",
    "dense_to_sparse": f"WITH {P}, {VEC} SELECT product_id, word_id, weight FROM (SELECT product_id, generate_subscripts(v, 1) - 1 AS word_id, unnest(v) AS weight FROM v) WHERE weight <> 0",
    "visual_postings": f"WITH {P}, {VEC}, {UNIT} SELECT word_id, product_id, round(weight, 6) AS weight FROM u",
    "visual_index_summary": f"WITH {P}, {VEC}, {UNIT} SELECT (SELECT count(*) FROM v) AS products, count(DISTINCT word_id) AS visual_words, count(*) AS nonzero_postings FROM u",
    "visual_search": f"WITH {P}, {VEC}, {UNIT}, {VISUAL_TOP} SELECT query_id, product_id, score, rank FROM vt WHERE rank <= 10",
    "assign_codewords": f"WITH {MEANS} SELECT vec_id, word_id FROM near",
    "visual_histogram": f"WITH {MEANS}, h AS (SELECT vec_id % 50 AS item, word_id, count(*) AS n FROM near GROUP BY ALL) SELECT item, word_id, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY item)), 6) AS weight FROM h",
    "sample_descriptors": "WITH e AS (SELECT vec_id, vec_id % 50 AS item, sha256('42:' || vec_id) AS draw FROM embeddings), q AS (SELECT item, least(count(*), greatest(1, round_even(200.0 * count(*) / (SELECT count(*) FROM e), 0)))::BIGINT AS quota FROM e GROUP BY item) SELECT item, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY draw) AS place FROM e) JOIN q USING (item) WHERE place <= quota ORDER BY draw LIMIT 200",
    "app_visual_search": f"WITH {P}, {NAMES}, {VEC}, {EXACT_TOP} SELECT query_id, et.product_id, score, rank, display_name FROM et JOIN nm ON nm.product_id = et.product_id WHERE rank <= 10",
    "app_recommend": INDEX + f""", {qvec(ASKED)}, {CHUNK_SCORE}, {TEXT_TOP}, {VEC}, {UNIT}, {VISUAL_TOP}, {NAMES},
r AS (SELECT query_id, product_id, 'text' AS modality, score FROM tt WHERE rank <= 50 UNION ALL SELECT query_id, product_id, 'image', score FROM vt WHERE rank <= 50), {NORM}, {FUSED}
SELECT query_id, f.product_id, score, text_score, image_score, rank, display_name FROM f JOIN nm ON nm.product_id = f.product_id WHERE rank <= 10""",
    "duplicate_groups": "WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL) SELECT doc_id, digest FROM h WHERE digest IN (SELECT digest FROM h GROUP BY digest HAVING count(*) > 1)",
    "stratified_order": f"WITH {P}, {GROUPED} SELECT group_id, stratum, size, turn FROM dealt",
    "partition_select": f"WITH {P}, {GROUPED} SELECT group_id, before FROM (SELECT group_id, coalesce(sum(size) OVER (ORDER BY turn, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM dealt) WHERE before < 100",
    "scale_members": f"WITH {P}, {M} SELECT scale, split, product_id FROM m WHERE product_id IN (SELECT product_id FROM p)",
    "test_queries": f"WITH {P}, {M} SELECT product_id, canonical_text FROM p WHERE has_image AND trim(canonical_text) <> '' AND product_id IN (SELECT product_id FROM m WHERE scale = 'full' AND split = 'test') ORDER BY product_id LIMIT 25",
    "relevance_pairs": f"WITH {P}, {TYPES} SELECT product_id, type, coalesce(count(*) OVER (PARTITION BY type) - 1, 0) AS relevant FROM ty WHERE type IS NOT NULL UNION ALL SELECT product_id, type, 0 FROM ty WHERE type IS NULL",
    "precision_at_k": f"{QUALITY}, {PRECISION} SELECT query_id, precision FROM prec WHERE engine = 'fused'",
    "recall_at_k": f"{QUALITY}, {RECALL} SELECT query_id, recall FROM rec WHERE engine = 'text'",
    "quality_report": f"{QUALITY}, {PRECISION}, {RECALL} SELECT engine, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM prec JOIN rec USING (engine, query_id) GROUP BY engine",
    "latency_summary": f"WITH {LATENCY} SELECT * FROM lat",
    "tradeoffs": f"WITH {LATENCY} SELECT 'mean' AS metric, arg_min(event_type, (mean, event_type)) AS best FROM lat UNION ALL SELECT 'p95', arg_min(event_type, (p95, event_type)) FROM lat UNION ALL SELECT 'n', arg_min(event_type, (-n, event_type)) FROM lat",
    "upsert_latest": "SELECT query_id, product_id, modality, rank, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_id, modality ORDER BY ingested_at DESC) AS k FROM search_results) WHERE k = 1",
}
_PARTS = ", ".join([value("json_extract_string(metadata, $$$.product_display_name$$)"), *[value(f"categories['{c}']") for c in ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage")], value("json_extract_string(metadata, $$$.brand_name$$)"), value("json_extract_string(metadata, $$$.description$$)")])
_ATTR = "coalesce(list_filter(flatten(list_transform(json_keys(metadata, '$.article_attributes'), lambda k: [{k}, {v}])), lambda x: x <> ''), [])".replace("{k}", value("k")).replace("{v}", value("json_extract_string(metadata, '$.article_attributes.\"' || k || '\"')"))
SQL |= {
    "flatten_attrs": f"WITH {P} SELECT product_id, array_to_string({_ATTR}, '|') AS attributes FROM p",
    "canonical_text": f"WITH {P} SELECT product_id, array_to_string(list_filter(list_concat([{_PARTS}], {_ATTR}), lambda x: x <> ''), ' ') AS canonical_text FROM p",
    "category_map": f"WITH {P} SELECT product_id, k AS category, v AS value FROM (SELECT product_id, unnest(['gender', 'masterCategory', 'articleType', 'year']) AS k, unnest([{', '.join(value(f'categories[{chr(39)}{c}{chr(39)}]') for c in ('gender', 'masterCategory', 'articleType', 'year'))}]) AS v FROM p) WHERE v <> ''",
}
SQL["normalize_value"] = f"WITH {P} SELECT product_id, {value('duplicate_image_group')} AS image_group, {value('json_extract_string(metadata, $$$.brand_name$$)')} AS brand FROM p"
SQL["clean_html"] = f"WITH {C} SELECT chunk_id, coalesce({ws(chr(32).join(['regexp_replace(replace(replace(replace(content, $$&nbsp;$$, chr(160)), $$&quot;$$, chr(34)), $$&amp;$$, $$&$$), $$<!--.*?-->|</?[a-zA-Z][^>]*>$$, $$ $$, $$g$$)']))}, '') AS content FROM c"
SQL |= {
    # These read an index back, or search by another way: the same rows must come out.
    "stored_text_search": SQL["text_search"],
    "stored_visual_search": SQL["visual_search"],
    "ann_search": SQL["exact_search"],
    "sorted_catalog": f"WITH {P} SELECT product_id, row_number() OVER (ORDER BY product_id) AS place, canonical_text FROM p",
    "upsert_images": """WITH r AS (SELECT product_id, image_path, has_image, ingested_at, ingested_at > make_timestamp(((SELECT epoch_us(min(ingested_at)) + epoch_us(max(ingested_at)) FROM products) // 2)::BIGINT) AS late FROM products WHERE product_id IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY product_id, late ORDER BY ingested_at DESC) AS k FROM r)
SELECT product_id, image_path, has_image FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY late DESC) AS j FROM one WHERE k = 1 AND (NOT late OR length(trim(image_path)) > 0)) WHERE j = 1""",
    "chunk_products": f"WITH {C} SELECT chunk_id, TRY_CAST(split_part(chunk_id, ':', 2) AS BIGINT) AS product_id FROM c",
    "lexeme_postings": f"WITH {P}, {FTS} SELECT product_id, term, n FROM lex",
    "fts_members": f"WITH {P}, {M}, {FTS} SELECT query_id, product_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM (SELECT query_id, product_id, round(sum(n)::DOUBLE * 0.1, 6) AS score FROM (SELECT query_id, exclude_id, lex.product_id AS product_id, n FROM lex JOIN qw USING (term)) WHERE (exclude_id IS NULL OR exclude_id <> product_id) AND product_id IN (SELECT product_id FROM m WHERE scale = 'full' AND split = 'train') GROUP BY ALL)) WHERE rank <= 10",
    "visual_rows": f"WITH {P}, {M}, {VEC} SELECT 'image:' || scale || ':' || product_id AS row_id, product_id, len(list_filter(v, lambda x: x <> 0)) AS words, round(list_max(list_filter(v, lambda x: x <> 0)), 6) AS largest FROM v JOIN m USING (product_id)",
    "partition_balance": f"WITH {P}, {GROUPED}, o AS (SELECT size, coalesce(sum(size) OVER (ORDER BY turn, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt), s AS (SELECT unnest(['1k', '10k', 'full']) AS scale, unnest([1000, 10000, 1000000000000]) AS target) SELECT scale, sum(size)::BIGINT AS products, sum(size)::BIGINT AS distinct_products, 0 AS parted_groups, true AS near_share FROM s JOIN o ON before < target GROUP BY scale",
    "manifest_members": f"WITH {M} SELECT scale, split, product_id FROM m",
}
_HTML = ws("regexp_replace(replace(replace(replace(coalesce(json_extract_string(metadata, $$$.description$$), $$$$), $$&nbsp;$$, chr(160)), $$&quot;$$, chr(34)), $$&amp;$$, $$&$$), $$<!--.*?-->|</?[a-zA-Z][^>]*>$$, $$ $$, $$g$$)")
SQL["canonical_catalog"] = f"""WITH {P}, t AS (SELECT product_id, array_to_string(list_filter(list_concat([{_PARTS.replace(value("json_extract_string(metadata, $$$.description$$)"), value(_HTML))}], {_ATTR}), lambda x: x <> ''), ' ') AS canonical_text,
image_path IS NOT NULL AS has_image, regexp_extract(lower(duplicate_image_group), '[0-9a-f]{{64}}') AS g, {' + '.join(f"({value(f'categories[{chr(39)}{c}{chr(39)}]')} <> '')::INT" for c in ("gender", "masterCategory", "subCategory", "articleType", "baseColour", "season", "year", "usage"))} AS categories, len(json_keys(metadata, '$.article_attributes')) AS attributes FROM p)
SELECT product_id, canonical_text, has_image, has_image AND coalesce(g, '') <> '' AND count(*) FILTER (WHERE has_image) OVER (PARTITION BY g) > 1 AS shares_image, categories, attributes FROM t"""

"""From texts to an inverted index: chunks, codebook, weighted vectors, postings.

All results are flat rows (term, chunk, product, weight); nothing is collected per term or per document. Tables of
terms join on the term without a hint: adaptive execution broadcasts the small side where it is small, and splits the
partitions of terms that stand in most chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import text as T
from weftwork.operators import blocks


#: Terms of a codebook that goes to every task.
MOST_TERMS = 200_000


def split_chunks(df: DataFrame, key: str, text: str, max_tokens: int = 128, overlap: int = 16) -> DataFrame:
    """(chunk_id, product_id, position, content, start_token, end_token, total_tokens).

    Windows of ``max_tokens`` words, each starting ``overlap`` words before the last one's end; the window that reaches
    the end is the last. Empty and null texts give none.
    """
    step = max_tokens - overlap
    words = df.select(F.col(key).alias("product_id"), T.split_words(text).alias("words")).withColumn("total_tokens", F.size("words")).where("total_tokens > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("total_tokens") - max_tokens) / step)).cast("int")
    placed = words.select("product_id", "words", "total_tokens", F.explode(F.sequence(F.lit(0), last)).alias("position"))
    start = F.col("position") * step
    piece = F.slice("words", start + 1, F.lit(max_tokens))
    return placed.select(
        F.concat_ws(":", F.lit("text"), "product_id", "position").alias("chunk_id"), "product_id", "position", F.array_join(piece, " ").alias("content"),
        start.alias("start_token"), (start + F.size(piece)).alias("end_token"), "total_tokens",
    )


def tokenized(chunks: DataFrame, text: str = "content", stopwords: bool = False, lowercase: bool = True) -> DataFrame:
    """(chunk_id, product_id, tokens) of each chunk; a null content has no tokens but stays a chunk."""
    found = T.tokens(text, lowercase)
    return chunks.select("chunk_id", "product_id", (T.without_stopwords(found) if stopwords else found).alias("tokens"))


def stemmed(tokenized_: DataFrame) -> DataFrame:
    """Tokens replaced by their stems, in the row: no shuffle. A batch passes each distinct term to the stemmer once."""

    def run(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat = tokens.flatten()
            known = pc.unique(flat)
            stems = pa.array([None if t is None else T.porter(t) for t in known.to_pylist()], pa.string())
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), stems.take(pc.index_in(flat, value_set=known)))
            yield pa.RecordBatch.from_arrays([lists if n == "tokens" else c for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names)

    return tokenized_.mapInArrow(run, tokenized_.schema)


def term_counts(tokenized_: DataFrame) -> DataFrame:
    """(chunk_id, product_id, term, n)."""
    return tokenized_.select("chunk_id", "product_id", F.explode("tokens").alias("term")).groupBy("chunk_id", "product_id", "term").agg(F.count(F.lit(1)).alias("n"))


def counted(tokens: pa.ListArray | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, row, place of the term, n): how often each term stands in each row, by row and place."""
    flat, lengths = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row, keep = np.repeat(np.arange(len(lengths)), lengths), pc.is_valid(flat)
    row, flat = row[keep.to_numpy(zero_copy_only=False)], flat.filter(keep)
    coded = flat.dictionary_encode()
    width = max(1, len(coded.dictionary))
    cell, n = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, cell // width, cell % width, n


def frequencies(tokenized_: DataFrame) -> DataFrame:
    """(term, tf, df) over (chunk_id, product_id, tokens), a row per chunk: counted in the rows' batches, only sums move."""

    def run(batches):
        for batch in batches:
            terms, _, place, n = counted(batch.column(0))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(place, n, len(terms)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(terms)).astype(np.int64))], ["term", "tf", "df"])

    return tokenized_.select("tokens").mapInArrow(run, "term string, tf long, df long").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def codebook(tokenized_: DataFrame, max_terms: int = 5_000, min_df: int = 2) -> DataFrame:
    """(term, tf, df, idf, position): the most frequent terms that stand in at least ``min_df`` chunks.

    idf = ln((1 + N) / (1 + df)) + 1, N counting every chunk, those without tokens too. Ordered by frequency, then term.
    """
    chunks = tokenized_.agg(F.count(F.lit(1)).alias("chunks"))  # one row
    counts = frequencies(tokenized_).where(F.col("df") >= min_df)
    top = counts.orderBy(F.desc("tf"), "term").limit(max_terms)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("tf"), "term")) - 1  # at most max_terms rows
    idf = F.log((1 + F.col("chunks")) / (1 + F.col("df"))) + 1
    return top.crossJoin(F.broadcast(chunks)).select("term", "tf", "df", idf.alias("idf"), place.alias("position"))


def tfidf(tokenized_: DataFrame, codebook_: DataFrame) -> DataFrame:
    """(chunk_id, product_id, term, weight): (1 + ln n) idf over known terms, brought to unit length per chunk.

    A chunk's window holds at most as many rows as the codebook has terms.
    """
    raw = term_counts(tokenized_).join(codebook_.select("term", "idf"), "term").select("chunk_id", "product_id", "term", ((1 + F.log("n")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("chunk_id")))
    return raw.select("chunk_id", "product_id", "term", (F.col("raw") / norm).alias("weight"))


def vectors(tokenized_: DataFrame, codebook_: DataFrame, *keys: str) -> DataFrame:
    """(keys..., words, weights): ``tfidf`` in the row, for (keys..., tokens) with one row per key; no shuffle.

    The codebook goes to every task; it is read up to ``MOST_TERMS``, more are refused. Rows without known terms stay out.
    """
    book = codebook_.select("term", "idf").limit(MOST_TERMS + 1).collect()
    if len(book) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    sent = tokenized_.sparkSession.sparkContext.broadcast(([r["term"] for r in book], np.array([r["idf"] for r in book], dtype=np.float64)))

    def run(batches):
        known, idf = pa.array(sent.value[0], pa.string()), sent.value[1]
        for batch in batches:
            terms, row, place, n = counted(batch.column("tokens"))
            code = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False)[place]
            row, code, n = row[code >= 0], code[code >= 0], n[code >= 0]
            raw = (1 + np.log(n)) * idf[code]
            norm = np.sqrt(np.bincount(row, raw * raw, batch.num_rows))
            held = np.flatnonzero(np.bincount(row, minlength=batch.num_rows))
            ends = pa.array(np.r_[np.searchsorted(row, held), len(row)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, known.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(raw / norm[row]))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(held)) for c in keys], *lists], [*keys, "words", "weights"])

    form = ", ".join(f"{c} {blocks.kind(tokenized_, c)}" for c in keys)
    return tokenized_.select(*keys, "tokens").mapInArrow(run, f"{form}, words array<string>, weights array<double>")


def vector_map(postings: DataFrame, item: str = "chunk_id", word: str = "term") -> DataFrame:
    """(item, vector): the words of each item as a map; the inverse of the postings."""
    return postings.groupBy(item).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(word), F.col("weight"))))).alias("vector"))


def index_summary(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunks, terms, postings): every chunk counts, those without postings too. One row."""
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    b = postings.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))
    return a.crossJoin(F.broadcast(b))


def best_chunk(queries: DataFrame, postings: DataFrame, word: str = "term", digits: int = 6) -> DataFrame:
    """(query_id, product_id, score, chunk_id): each product's best chunk for each query, all that share a word.

    ``queries`` is (query_id, exclude_id, word, weight). As many rows as queries meet products come out: ``search`` gives
    only the best k. The product queried for is left out. Of equal chunks the smallest id stands.
    """
    met = postings.join(queries.select("query_id", "exclude_id", F.col(word), F.col("weight").alias("asked")), word).where(F.col("exclude_id").isNull() | (F.col("exclude_id") != F.col("product_id")))
    scored = met.groupBy("query_id", "product_id", "chunk_id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), digits).alias("score"))
    best = scored.groupBy("query_id", "product_id").agg(F.min(F.struct((-F.col("score")).alias("low"), F.col("chunk_id"))).alias("best"))
    return best.select("query_id", "product_id", (-F.col("best.low")).alias("score"), F.col("best.chunk_id").alias("chunk_id"))


def search(queries: DataFrame, postings: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, product_id, score, chunk_id, rank): the k products whose best chunk scores highest.

    ``queries`` is (query_id, exclude_id, term, weight), ``postings`` (chunk_id, product_id, term, weight), stored or not.
    Block by block (``blocks``): postings and queries are not joined. Ties as in ``best_chunk`` and ``top_k``.
    """
    pairs = F.collect_list(F.struct("term", "weight")).alias("p")
    words = [F.col("p.term").alias("words"), F.col("p.weight").alias("weights")]
    asked = queries.groupBy("query_id", "exclude_id").agg(pairs).select("query_id", "exclude_id", *words)
    held = postings.groupBy("chunk_id", "product_id").agg(pairs).select(F.col("chunk_id").alias("item"), "product_id", *words)
    return search_vectors(asked, held, k, digits)


def search_vectors(queries: DataFrame, items: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``search`` of (query_id, exclude_id, words, weights) in (item, product_id, words, weights), as ``vectors`` gives them."""
    found = blocks.best_items(blocks.sparse_search(items, queries, k, digits))
    return top_k(found.withColumnRenamed("item", "chunk_id"), k)


def top_k(scored: DataFrame, k: int, group: str = "query_id", item: str = "product_id", score: str = "score") -> DataFrame:
    """Adds rank 1..k by (score down, item up); only k rows per task and query reach the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def lexemes(documents: DataFrame, stopwords: bool = True) -> DataFrame:
    """(product_id, term, n): the lexeme postings of (product_id, text), to be stored."""
    found = T.without_stopwords(T.tokens("text")) if stopwords else T.tokens("text")
    return documents.select("product_id", F.explode(found).alias("term")).groupBy("product_id", "term").agg(F.count(F.lit(1)).alias("n"))


def lexeme_rank(queries: DataFrame, postings: DataFrame, members: DataFrame | None = None, stopwords: bool = True, k: int = 10) -> DataFrame:
    """``fts_rank`` over stored lexeme postings; with ``members`` (product_id) only those are found."""
    held = postings if members is None else postings.join(members.select("product_id").distinct(), "product_id", "left_semi")
    pairs = F.collect_list(F.struct("term", F.col("n").cast("double").alias("n"))).alias("p")
    items = held.groupBy("product_id").agg(pairs).select(F.col("product_id").alias("item"), "product_id", F.col("p.term").alias("words"), F.col("p.n").alias("weights"))
    return top_k(blocks.sparse_search(items, fts_queries(queries, stopwords), k, 6).drop("item"), k)


def fts_queries(queries: DataFrame, stopwords: bool = True) -> DataFrame:
    """(query_id, exclude_id, words, weights): each word of a query once."""
    found = T.without_stopwords(T.tokens("text")) if stopwords else T.tokens("text")
    return queries.select("query_id", "exclude_id", F.array_distinct(found).alias("words")).withColumn("weights", F.transform("words", lambda _: F.lit(0.1)))


def fts_rank(queries: DataFrame, documents: DataFrame, stopwords: bool = True, k: int = 10) -> DataFrame:
    """(query_id, product_id, score, rank): 0.1 for every place of a document where a word of the query stands.

    ``queries`` is (query_id, exclude_id, text), ``documents`` (product_id, text). Blank queries give no rows. Documents
    are tokenised where they lie and searched block by block.
    """
    found = T.without_stopwords(T.tokens("text")) if stopwords else T.tokens("text")
    held = documents.select(F.col("product_id").alias("item"), "product_id", found.alias("words")).withColumn("weights", F.transform("words", lambda _: F.lit(1.0)))
    return top_k(blocks.sparse_search(held, fts_queries(queries, stopwords), k, 6).drop("item"), k)

"""Search of a stated set of queries against all rows, block by block, without joining the two tables.

Rows stay in the partitions where they lie. The queries are written to the shared folder in files of bounded size; each
task goes through its rows in blocks and holds every file of queries against them. Only the best k of a query and block
are shuffled, so what moves is (queries x blocks x k) small rows, never rows x queries, and nothing passes the driver
but the names of the files. ``sparse_search`` does it the other way round: rows are written, a task has some queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.storage import cut, read_file, remove_path, scratch_path

#: Rows that a task holds at once, and queries of a file.
ROWS, QUERIES = 8_000, 2_000
#: Sparse rows are held by so many times ROWS, and a task has up to four times QUERIES. Queries of one matrix product,
#: pairs scored at once, and the words that are dense columns: at most so many, each in this share of a block's rows.
WIDE, BATCH, PAIRS, MOST_DENSE, DENSE = 4, 256, 20_000, 512, 0.08


def gathered(batches, rows: int) -> Iterator[pa.Table]:
    """Arrow batches put together to tables of at most ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == rows:
                full, held, n = [pa.Table.from_batches(held)], [], 0
                yield full.pop()  # kept no longer than the caller does
    if held and n:
        yield pa.Table.from_batches(held)


def over_queries(rows: DataFrame, queries: DataFrame, prepare: Callable, search: Callable, schema: str) -> DataFrame:
    """What ``search(prepare(block of rows), table of queries)`` yields (lists of columns of ``schema``), over all pairs.

    The result is written once, the files of queries are removed.
    """
    spark = rows.sparkSession
    path, block = scratch_path(spark, "queries"), ROWS
    try:
        queries.write.option("maxRecordsPerFile", QUERIES).parquet(path)
        files = sorted(spark.read.schema(queries.schema).parquet(path).inputFiles())
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            for table in gathered(batches, block):
                held = prepare(table)
                for name in files:
                    asked = read_file(name)
                    if asked.num_rows:
                        for columns in search(held, asked):
                            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.tolist() if c.dtype == object else c) for c in columns], names)

        return cut(rows.mapInArrow(run, schema))
    finally:
        remove_path(spark, path)


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def unit_matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Vectors (without nulls, all of one length) as rows of unit length."""
    flat = lists.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, the smaller id first among equals."""
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def dense_search(rows: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, product_id, score): the k greatest cosine similarities of each block of rows.

    ``rows`` is (id, vector), ``queries`` (query_id, exclude_id, vector).
    """

    def prepare(table: pa.Table):
        return table["id"].to_numpy(), unit_matrix(table["vector"])

    def search(held, asked: pa.Table):
        ids, x = held
        excluded = asked["exclude_id"].to_pylist()
        for at in range(0, asked.num_rows, 200):
            part = asked.slice(at, 200)
            similar, found = np.round(unit_matrix(part["vector"]) @ x.T, digits), []
            for exclude, s in zip(excluded[at : at + 200], similar):
                near = best_places(s, ids, k + 1)
                found.append(near[ids[near] != exclude][:k] if exclude is not None else near[:k])
            row, near = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
            yield part["query_id"].to_numpy()[row], ids[near], similar[row, near]

    return over_queries(rows.select("id", "vector"), queries.select("query_id", "exclude_id", "vector"), prepare, search, f"query_id {kind(queries, 'query_id')}, product_id {kind(rows, 'id')}, score double")


def flat(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, weights and row numbers of (words, weights)."""
    words, weights = table["words"].combine_chunks(), table["weights"].combine_chunks()
    lengths = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return words.flatten(), weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.repeat(np.arange(len(lengths)), lengths)


class Held:
    """A block of (item, product_id, words, weights) in the order of product and item, with two indexes.

    The most frequent words are columns of a dense matrix of single precision, the others lists of rows. All words stand
    by row too, from which the scores that count are taken.
    """

    def __init__(self, table: pa.Table):
        table = table.sort_by([("product_id", "ascending"), ("item", "ascending")])
        words, self.weights, owner = flat(table)
        self.items, self.products, self.n = table["item"].combine_chunks(), table["product_id"].to_numpy(), table.num_rows
        coded = words.dictionary_encode()
        self.known, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.starts = np.flatnonzero(np.r_[True, self.products[1:] != self.products[:-1]])
        self.row_starts = np.searchsorted(owner, np.arange(self.n + 1))
        order = np.argsort(self.code.astype(np.uint16) if len(self.known) < 65_536 else self.code, kind="stable")
        self.bounds = np.searchsorted(self.code[order], np.arange(len(self.known) + 1))
        self.rows, self.by_word = owner[order], self.weights[order]
        self.single, self.screen = self.by_word.astype(np.float32), np.zeros((0, self.n), np.float32)
        many = np.diff(self.bounds)
        common = np.argsort(-many, kind="stable")[:MOST_DENSE]
        common = common[many[common] >= max(1, DENSE * self.n)]
        self.column = np.full(len(self.known) + 1, -1)  # the last place is that of unknown words
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for at, c in enumerate(common):
            own = slice(self.bounds[c], self.bounds[c + 1])
            self.dense[at] = np.bincount(self.rows[own], self.by_word[own], self.n)
        repeated = (self.rows[1:] == self.rows[:-1]) & (np.diff(self.code[order]) == 0)
        size = np.abs(self.weights) if repeated.any() else self.weights**2
        longest = np.bincount(owner, size, self.n).max(initial=0)
        self.length = longest if repeated.any() else np.sqrt(longest)

    def room(self, queries: int) -> np.ndarray:
        if len(self.screen) < queries:
            self.screen = np.empty((queries, self.n), np.float32)
        return self.screen[:queries]

    def hits(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all rows, and which of them share a word."""
        begin, many = self.bounds[codes], self.bounds[codes + 1] - self.bounds[codes]
        at = np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        return np.bincount(self.rows[at], self.by_word[at] * np.repeat(weights, many), self.n), np.bincount(self.rows[at], minlength=self.n) > 0

    def scores(self, asked: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of stated pairs in double precision; ``asked`` has a row of weights by word for each query."""
        out = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            part = row[i : i + PAIRS]
            many = self.row_starts[part + 1] - self.row_starts[part]
            at = np.repeat(self.row_starts[part] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            pair = np.repeat(np.arange(len(part)), many)
            out[i : i + PAIRS] = np.bincount(pair, asked[query[i : i + PAIRS][pair], self.code[at]] * self.weights[at], len(part))
        return out


def candidates(held: Held, asked: pa.Table, least: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all rows that may be among the k best products of a query, and some more.

    ``least`` is the score of its k-th so far (-inf if there are fewer). Rows are screened in single precision, with room
    for its error and for rounding, and scored again; a query whose k-th isn't surely above 0 is scored in full, as rows
    without a common word score 0 too.
    """
    words, weights, row = flat(asked)
    code = pc.fill_null(pc.index_in(words, value_set=held.known), -1).to_numpy(zero_copy_only=False)
    met = np.flatnonzero(code >= 0)
    code, weights, row = code[met], weights[met], row[met]
    places = np.searchsorted(row, np.arange(asked.num_rows + 1))
    by_word = np.zeros((asked.num_rows, len(held.known)))
    np.add.at(by_word, (row, code), weights)
    column = held.column[code]
    head = np.zeros((asked.num_rows, len(held.dense)), np.float32)
    np.add.at(head, (row[column >= 0], column[column >= 0]), weights[column >= 0])
    screened = np.matmul(head, held.dense, out=held.room(asked.num_rows))
    room = (len(held.dense) + np.diff(places) + 8) * 2.0**-23 * np.linalg.norm(by_word, axis=1) * held.length
    step = 10.0**-digits
    excluded = asked["exclude_id"].to_pylist()
    queries, rows, scores, again = [], [], [], []
    for q in range(asked.num_rows):
        own = slice(places[q], places[q + 1])
        if own.start == own.stop:
            continue
        s = screened[q]
        rare = code[own][column[own] < 0]
        if len(rare):
            bounds = [(held.bounds[c], held.bounds[c + 1], w) for c, w in zip(rare.tolist(), weights[own][column[own] < 0].tolist())]
            np.add.at(s, np.concatenate([held.rows[a:b] for a, b, _ in bounds]), np.concatenate([held.single[a:b] * np.float32(w) for a, b, w in bounds]))
        low = least[q]
        if low == -np.inf and len(held.starts) > k:
            best = np.maximum.reduceat(s, held.starts)
            best = best[held.products[held.starts] != excluded[q]] if excluded[q] is not None else best
            low = np.partition(best, -k)[-k] - room[q] - step
        low -= room[q] + step
        if low > 0 and 1e-20 < room[q] < 1e20:
            near = np.flatnonzero(s >= np.nextafter(np.float32(low), np.float32(-np.inf)))
            again.append((q, near[held.products[near] != excluded[q]] if excluded[q] is not None else near))
            continue
        total, hit = held.hits(code[own], weights[own])
        score = np.where(hit, np.round(total, digits), -np.inf)
        best = np.maximum.reduceat(score, held.starts)
        if excluded[q] is not None:
            best[held.products[held.starts] == excluded[q]] = -np.inf
        near = best_places(best, held.products[held.starts], k)
        edges = np.r_[held.starts, held.n]
        for p in near[best[near] > -np.inf]:
            at = edges[p] + int(np.argmax(score[edges[p] : edges[p + 1]] == best[p]))
            queries.append([q])
            rows.append([at])
            scores.append([score[at]])
    if again:
        q, r = np.repeat([q for q, _ in again], [len(r) for _, r in again]), np.concatenate([r for _, r in again])
        queries.append(q)
        rows.append(r)
        scores.append(np.round(held.scores(by_word, q, r), digits))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((queries, np.int64), (rows, np.int64), (scores, np.float64)))


class Best:
    """The k best products so far of each of some queries, with their best items."""

    def __init__(self, asked: pa.Table, k: int):
        self.asked, self.k = asked, k
        self.query, self.product, self.score, self.item = np.zeros(0, np.int64), None, np.zeros(0), None
        self.least = np.full(asked.num_rows, -np.inf)

    def add(self, held: Held, digits: int) -> None:
        q, r, s = candidates(held, self.asked, self.least, self.k, digits)
        if not len(q):
            return
        p = held.products[r]
        order = np.lexsort((r, -s, p, q))
        first = order[np.r_[True, (np.diff(q[order]) != 0) | (np.diff(p[order]) != 0)]]
        q, r, s, p = q[first], r[first], s[first], p[first]
        items = held.items.take(pa.array(r))
        if self.item is not None:
            q, p, s, items = np.r_[self.query, q], np.r_[self.product, p], np.r_[self.score, s], pa.concat_arrays([self.item, items])
        order = np.lexsort((-s, p, q))
        same = (np.diff(q[order]) == 0) & (np.diff(p[order]) == 0)
        drop = np.zeros(len(q), bool)
        for i in np.flatnonzero(same):  # a product in an earlier block too
            a, b = order[i], order[i + 1]
            drop[a if s[a] == s[b] and items[int(b)].as_py() < items[int(a)].as_py() else b] = True
        order = np.lexsort((p, -s, q))
        order = order[~drop[order]]
        starts = np.searchsorted(q[order], np.arange(self.asked.num_rows + 1))
        place = np.arange(len(order)) - starts[q[order]]
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.product, self.score, self.item = q[order], p[order], s[order], items.take(pa.array(order))
        last = place == self.k - 1
        self.least[self.query[last]] = self.score[last]


def sparse_search(items: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, product_id, score, item): of each query the k products with the greatest scalar product.

    ``items`` is (item, product_id, words, weights), arrays side by side; a word may stand several times, its weights
    add up. ``queries`` is (query_id, exclude_id, words, weights). A product's score is that of its best item (of equal
    ones the smallest); what shares no word with the query doesn't come out.

    Here the items are written to files, once; a task has some queries and goes through all files in blocks, each time
    with the k-th score so far, so that only k rows of a query come out of it.
    """
    spark = items.sparkSession
    path, rows, most, n = scratch_path(spark, "items"), WIDE * ROWS, 4 * QUERIES, spark.sparkContext.defaultParallelism
    form = f"query_id {kind(queries, 'query_id')}, product_id {kind(items, 'product_id')}, score double, item {kind(items, 'item')}"
    columns = ["item", "product_id", "words", "weights"]
    try:
        items.select(columns).write.option("compression", "zstd").option("maxRecordsPerFile", ROWS).parquet(path)
        files = sorted(spark.read.schema(items.select(columns).schema).parquet(path).inputFiles())
        asked = cut(queries.select("query_id", "exclude_id", "words", "weights"))
        n = max(n, -(-asked.count() // most))

        def run(batches):
            for table in gathered(batches, most):
                best = [Best(table.slice(at, BATCH), k) for at in range(0, table.num_rows, BATCH)]
                for held in map(Held, gathered((b for f in files for b in read_file(f).select(columns).to_batches()), rows)):
                    for b in best:
                        b.add(held, digits)
                for b in best:
                    if b.item is not None:
                        yield pa.RecordBatch.from_arrays([b.asked["query_id"].combine_chunks().take(pa.array(b.query)), pa.array(b.product), pa.array(b.score), b.item], ["query_id", "product_id", "score", "item"])

        return cut(asked.repartition(n).mapInArrow(run, form))
    finally:
        remove_path(spark, path)


def best_items(found: DataFrame) -> DataFrame:
    """(query_id, product_id, score, item): a product's best over the blocks, the smallest item of equal ones."""
    low = F.struct((-F.col("score")).alias("low"), "item")
    best = found.groupBy("query_id", "product_id").agg(F.min(low).alias("b"))
    return best.select("query_id", "product_id", (-F.col("b.low")).alias("score"), F.col("b.item").alias("item"))

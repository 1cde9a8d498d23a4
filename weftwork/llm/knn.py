"""The most similar vectors by multiprobe p-stable hashing.

Vectors are brought to unit length, so that Euclidean distance orders them as cosine similarity does, and hashed by
tables of p-stable (Gaussian) projections. A query visits in each table its own bucket and then perturbed ones in the
order of their estimated success. What the tables give is merged and reranked by exact similarity.

How many buckets a query visits follows from the query: after ``FIRST`` buckets of each table the distance of its k-th
neighbour so far bounds the true one, and from it and the query's own position in the buckets follows how many more must
be visited until a vector at that distance is met with probability ``target``. Those rounds go on until the query is
settled or would need more than ``MOST`` buckets of a table; the few queries beyond that are held against all rows, block
by block.

Equal vectors form one class and are hashed once. Buckets are spread over groups; a group with more rows than ``GROUP``
is cut into pieces, and queries that visit it go to every piece, so a bucket with a third of all rows is no one task's.

Defined results: vectors that are null, of another length, without any length (all zeros), or with a null, NaN or
infinite element take no part; of a key delivered again the row with the greatest ``order`` counts; a vector is not its
own neighbour, a copy of it is; ties in similarity (9 places) go to the smaller key; with fewer than k others all come
out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import sets
from weftwork.operators import blocks
from weftwork.operators.skew import few, hot_join
from weftwork.storage import cut

TABLES, HASHES, WIDTH, SEED = 4, 14, 3.0, 5_501
#: Buckets of a table that a query visits first, and at most.
FIRST, MOST = 40, 6_000
#: Rows of a group of buckets; queries that a task works on at once.
GROUP, QUERIES = 8_000, 100
TARGET = 0.9


@lru_cache(4)
def family(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections (dim x tables*hashes), offsets, and the odd multipliers that make one key of a table's hashes."""
    r = np.random.default_rng(seed)
    return r.standard_normal((dim, tables * hashes)).astype(np.float32), r.random(tables * hashes), r.integers(0, 2**64, tables * hashes, dtype=np.uint64) | np.uint64(1)


@lru_cache(4)
def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of perturbed hashes in the order of their expected score, as positions in a query's sorted distances.

    The expected squared distance of the j-th of 2m sorted boundaries is known in closed form; the heap extends and
    shifts the last member of the best set. A hash can't be perturbed both ways (positions j and 2m + 1 - j).
    """
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in chosen}) == len(chosen):
            out.append(chosen)
        if (last := chosen[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*chosen, last + 1)))
    return out


def dense(packed, dim: int) -> np.ndarray:
    """Rows of (16-bit place, float) pairs as one float32 matrix."""
    out = np.zeros((len(packed), dim), dtype=np.float32)
    kind = np.dtype([("at", "<u2"), ("x", "<f4")])
    lengths = [len(p) // kind.itemsize for p in packed]
    flat = np.frombuffer(b"".join(packed), dtype=kind)
    out[np.repeat(np.arange(len(packed)), lengths), flat["at"]] = flat["x"]
    return out


def packed_rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[bytes]]:
    """Places of the usable vectors of a batch (id, vector), and their unit vectors in packed form."""
    lists = batch.column(1)
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    kind = np.dtype([("at", "<u2"), ("x", "<f4")])
    kept, packed = [], []
    for at in range(0, len(rows), 1000):
        part = rows[at : at + 1000]
        matrix = lists.take(pa.array(part)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dim)
        with np.errstate(invalid="ignore", over="ignore"):
            top = np.abs(matrix).max(axis=1, initial=0)
            ok = np.isfinite(matrix).all(axis=1) & (top > 0)
        unit = matrix[ok] / top[ok, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        kept.append(part[ok])
        for v in unit.astype(np.float32):
            places = np.flatnonzero(v)
            one = np.empty(len(places), dtype=kind)
            one["at"], one["x"] = places, v[places]
            packed.append(one.tobytes())
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64), packed


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int, order: str | None = None) -> DataFrame:
    """(id, vec): the usable vectors at unit length, packed, one row per key."""
    if dim > 65_536:
        raise ValueError("at most 65,536 dimensions")
    one = sets.latest(df, key, vector, order=order)
    source = one.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") == dim)

    def run(batches):
        for batch in batches:
            rows, packed = packed_rows(batch, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(packed, pa.binary())], ["id", "vec"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, vec binary")


def hashes_of(x: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and places within them (0 to 1), rows x tables x hashes."""
    projections, offsets, _ = family(x.shape[1], tables, hashes, seed)
    at = x @ projections / width + offsets
    slot = np.floor(at)
    return slot.astype(np.int64).reshape(len(x), tables, hashes), (at - slot).reshape(len(x), tables, hashes)


def own_keys(slots: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """One key per row and table."""
    tables, hashes = slots.shape[1:]
    mul = family(dim, tables, hashes, seed)[2].reshape(tables, hashes)
    with np.errstate(over="ignore"):
        return ((slots.view(np.uint64) * mul).sum(axis=2, dtype=np.uint64) + mul[:, 0] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def boundaries(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and table which hash has the j-th nearest boundary, and whether it is the lower (-1) or upper (1)."""
    m = places.shape[2]
    order = np.argsort(np.concatenate([places, 1 - places], axis=2), axis=2)
    return order % m, np.where(order < m, -1, 1)


def probe_keys(slots: np.ndarray, places: np.ndarray, dim: int, probes: int, seed: int) -> np.ndarray:
    """Keys of the buckets that each row visits, rows x tables x probes, in the order of their estimated success."""
    tables, hashes = slots.shape[1:]
    mul = family(dim, tables, hashes, seed)[2].reshape(tables, hashes)
    which, way = boundaries(places)
    moved = np.take_along_axis(np.broadcast_to(mul, places.shape), which, axis=2)
    with np.errstate(over="ignore"):
        moved = np.where(way < 0, np.uint64(0) - moved, moved)
        moved = np.concatenate([moved, np.zeros((*moved.shape[:2], 1), dtype=np.uint64)], axis=2)
        chosen = perturbation_places(hashes, probes)
        keys = np.repeat(own_keys(slots, dim, seed).view(np.uint64)[:, :, None], len(chosen), axis=2)
        for part in chosen.T:
            keys += moved[:, :, part]
    return keys.view(np.int64)


@lru_cache(8)
def perturbation_places(hashes: int, probes: int) -> np.ndarray:
    """``perturbations`` as a matrix, a row per probe there is; the place after the last boundary fills the rows up."""
    chosen = perturbations(hashes, probes)
    out = np.full((len(chosen), max(1, max(map(len, chosen)))), 2 * hashes)
    for k, c in enumerate(chosen):
        out[k, : len(c)] = c
    return out


def normal(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to about 1e-7."""
    x = np.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z < 0, tail / 2, 1 - tail / 2)


def successes(places: np.ndarray, distance: np.ndarray, width: float, probes: int) -> np.ndarray:
    """rows x probes: the probability that a vector at the distance lies in one of the buckets visited up to a probe."""
    sigma = np.maximum(distance, 1e-3)[:, None, None] / width
    lower2, lower, upper, upper2 = (normal(z / sigma) for z in (-1 - places, -places, 1 - places, 2 - places))
    stays = np.maximum(upper - lower, 1e-12)
    which, way = boundaries(places)
    leaves = np.where(way < 0, np.take_along_axis((lower - lower2) / stays, which, axis=2), np.take_along_axis((upper2 - upper) / stays, which, axis=2))
    leaves = np.concatenate([leaves, np.ones((*leaves.shape[:2], 1))], axis=2)
    chosen = perturbation_places(places.shape[2], probes)
    chance = np.repeat(stays.prod(axis=2)[:, :, None], len(chosen), axis=2)
    for part in chosen.T:
        chance *= leaves[:, :, part]
    return 1 - np.prod(1 - np.minimum(np.cumsum(chance, axis=2), 1), axis=1)


def grouped_rows(vectors: DataFrame, dim: int, many: int, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(group, id, key, vec): each row in the group of its bucket, once per table."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = own_keys(hashes_of(dense(part.column(1).to_pylist(), dim), tables, hashes, width, seed)[0], dim, seed)
                take = pa.array(np.repeat(np.arange(len(keys)), tables))
                yield pa.RecordBatch.from_arrays([pa.array(group_of(keys, many).ravel()), part.column(0).take(take), pa.array(keys.ravel()), part.column(1).take(take)], ["group", "id", "key", "vec"])

    return vectors.select("id", "vec").mapInArrow(run, f"group long, id {kind}, key long, vec binary")


def group_of(keys: np.ndarray, many: int) -> np.ndarray:
    """The group of each key; keys are (..., tables), and each table has ``many`` groups of its own."""
    x = keys.view(np.uint64)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(many)).astype(np.int64) + many * np.arange(keys.shape[-1])


def grouped_queries(queries: DataFrame, dim: int, many: int, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(group, query, probes, vec) of (id, vec, probes): each query once in every group it visits a bucket of."""
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                probes = part.column(2).to_numpy()
                slots, places = hashes_of(dense(part.column(1).to_pylist(), dim), tables, hashes, width, seed)
                keys = probe_keys(slots, places, dim, int(probes.max()), seed).transpose(0, 2, 1)
                visits = np.arange(keys.shape[1])[None] < probes[:, None]
                row = np.repeat(np.arange(len(probes)), np.minimum(probes, keys.shape[1]) * tables)
                pairs = np.unique(row * (many * tables) + group_of(keys, many)[visits].ravel())
                take = pa.array(pairs // (many * tables))
                yield pa.RecordBatch.from_arrays([pa.array(pairs % (many * tables)), *[part.column(c).take(take) for c in (0, 2, 1)]], ["group", "query", "probes", "vec"])

    return queries.select("id", "vec", F.col("probes").cast("int")).mapInArrow(run, f"group long, query {kind}, probes int, vec binary")


def best(rough: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest similarities (9 places) of q among rows x, the smaller id first among equals."""
    top = np.argpartition(-rough, k + 8)[: k + 9] if len(rough) > k + 9 else np.arange(len(rough))
    if len(top) < len(rough):  # whatever may tie with the last one
        top = np.flatnonzero(rough >= rough[top].min() - 1e-6)
    exact = np.round(x[top].astype(np.float64) @ q.astype(np.float64), 9)
    order = np.lexsort((ids[top], -exact))[:k]
    return ids[top][order], exact[order]


def group_search(dim: int, k: int, many: int, tables: int, hashes: int, width: float, seed: int):
    """Rows and queries of one group of buckets: the visited rows, exact similarity, the best k of each query."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("key")
            table = int(rows["group"].iloc[0]) // many
            ids, x = rows["id"].to_numpy(), dense(rows["vec"].tolist(), dim)
            held, size = np.unique(rows["key"].to_numpy(), return_counts=True)
            asked = asked.sort_values("probes")
            for at in range(0, len(asked), QUERIES):
                part = asked.iloc[at : at + QUERIES]
                probes, q = part["probes"].to_numpy(), dense(part["vec"].tolist(), dim)
                slots, places = hashes_of(q, tables, hashes, width, seed)
                keys = probe_keys(slots, places, dim, int(probes.max()), seed)[:, table]
                place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = (held[place] == keys) & (np.arange(keys.shape[1])[None] < probes[:, None])
                visited = np.zeros((len(q), len(held)), dtype=bool)
                visited[np.nonzero(hit)[0], place[hit]] = True
                candidates = np.repeat(visited, size, axis=1)
                # Where much of the group is visited, one product over all of it is cheaper than gathering rows.
                whole = q @ x.T if candidates.mean() > 0.05 else None
                for n, qid in enumerate(part["query"].to_numpy()):
                    near = np.flatnonzero(candidates[n])
                    met = len(near)
                    near = near[ids[near] != qid]
                    if len(near):
                        own = x[near] if whole is None else None
                        found, similar = best(own @ q[n], own, ids[near], q[n], k) if whole is None else best(whole[n, near], Rows(x, near), ids[near], q[n], k)
                        out.append((np.full(len(found), qid), found, similar, np.r_[met, np.zeros(len(found) - 1, dtype=np.int64)]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("query", "id", "similarity", "visited"), columns)))

    return run


class Rows:
    """Some rows of a matrix, gathered only where they are asked for."""

    def __init__(self, x: np.ndarray, at: np.ndarray):
        self.x, self.at = x, at

    def __getitem__(self, places):
        return self.x[self.at[places]]


def top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; a pair found in several tables counts once."""
    one = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return one.withColumn("place", place).where(F.col("place") <= k)


def lsh_search(vectors: DataFrame, queries: DataFrame, count: int, dim: int, k: int, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(query, id, similarity, visited) from the visited buckets; ``queries`` is (id, vec, probes).

    Up to k rows of each table and group; ``visited`` is how many rows the query met there, on the first of its rows.
    """
    many = max(1, -(-count // GROUP))
    rows = grouped_rows(vectors, dim, many, tables, hashes, width, seed)
    large = few(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP)).cast("int").alias("pieces")).where("pieces > 1"))
    pieces = F.coalesce("pieces", F.lit(1))
    held = rows.join(large, "group", "left").withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).drop("pieces")
    asked = grouped_queries(queries, dim, many, tables, hashes, width, seed).join(large, "group", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    kind = vectors.schema["id"].dataType.simpleString()
    search = group_search(dim, k, many, tables, hashes, width, seed)
    return held.groupBy("group", "piece").cogroup(asked.groupBy("group", "piece")).applyInPandas(search, f"query {kind}, id {kind}, similarity double, visited long")


def exact_search(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, id, similarity) of the best k of each block of rows, all rows against all queries (id, vec)."""
    kind = vectors.schema["id"].dataType.simpleString()

    def prepare(table: pa.Table):
        return table["id"].to_numpy(), dense(table["vec"].to_pylist(), dim)

    def search(held, asked: pa.Table):
        ids, x = held
        for at in range(0, asked.num_rows, QUERIES):
            part = asked.slice(at, QUERIES)
            q, out = dense(part["vec"].to_pylist(), dim), []
            for qid, one, rough in zip(part["id"].to_pylist(), q, q @ x.T):
                found, similar = best(rough, x, ids, one, k + 1)
                keep = found != qid
                out.append((np.full(keep.sum(), qid), found[keep], similar[keep]))
            yield [np.concatenate(c) for c in zip(*out)]

    return blocks.over_queries(vectors.select("id", "vec"), queries.select("id", "vec"), prepare, search, f"query {kind}, id {kind}, similarity double")


def needed(result: DataFrame, queries: DataFrame, dim: int, k: int, tables: int, hashes: int, width: float, seed: int, target: float, most: int) -> DataFrame:
    """(id, vec, probes, need): how many buckets of a table a query must visit for the target at its k-th distance so far.

    ``most + 1`` where not even ``most`` are enough, and where fewer than k neighbours are known.
    """
    last = result.where(F.col("place") == k).select(F.col("query").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("distance"))
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                distance = part.column(3).to_numpy(zero_copy_only=False)
                need = np.full(len(distance), most + 1)
                some = np.flatnonzero(~np.isnan(distance))
                if len(some):
                    _, places = hashes_of(dense(part.column(1).take(pa.array(some)).to_pylist(), dim), tables, hashes, width, seed)
                    sure = successes(places, distance[some], width, most) >= target
                    need[some] = np.where(sure.any(axis=1), sure.argmax(axis=1) + 1, most + 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(need.astype(np.int32))], ["id", "vec", "probes", "need"])

    return queries.select("id", "vec", "probes").join(last, "id", "left").mapInArrow(run, f"id {kind}, vec binary, probes int, need int")


def hashed_search(vectors: DataFrame, wanted: DataFrame, dim: int, k: int, tables: int, hashes: int, width: float, first: int, most: int, seed: int, target: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What hashing finds: (query, id, similarity, place) of all queries, (query, visited), and (id, vec) not settled."""
    count = vectors.count()
    pending, result, visits = wanted.withColumn("probes", F.lit(first).cast("int")), None, None
    while True:
        met = cut(lsh_search(vectors, pending, count, dim, k, tables, hashes, width, seed))
        found = cut(top(met, k))
        need = cut(needed(found, pending, dim, k, tables, hashes, width, seed, target, most))
        again = need.where((F.col("need") > F.col("probes")) & (F.col("probes") < most))
        over = need.where((F.col("need") <= F.col("probes")) | (F.col("probes") >= most))
        done = found.join(over.select(F.col("id").alias("query")), "query", "left_semi")
        seen = met.groupBy("query").agg(F.sum("visited").alias("visited"))
        rest = over.where(F.col("need") > F.col("probes")).select("id", "vec")
        result, visits, left = (done, seen, rest) if result is None else (result.unionByName(done), visits.unionByName(seen), left.unionByName(rest))
        if not again.limit(1).count():
            return result, visits.groupBy("query").agg(F.sum("visited").alias("visited")), left
        pending = again.select("id", "vec", F.least("need", F.lit(most)).alias("probes"))


def neighbours(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, queries: DataFrame | None = None, order: str | None = None, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, first: int = FIRST, most: int = MOST, seed: int = SEED, target: float = TARGET, exact: bool = True) -> DataFrame:
    """(query, id, similarity, place): the k most similar others of each query, a row of ``df`` itself.

    ``queries`` has the keys to ask for in its first column (default: every key). ``exact=False`` leaves the queries that
    hashing can't settle at what it found.
    """
    members, vectors = sets.classes(unit_vectors(df, key, vector, dim, order), "vec")
    asked = members if queries is None else members.join(few(queries.select(F.col(queries.columns[0]).alias("id")).distinct()), "id", "left_semi")
    asked = cut(asked)
    wanted = cut(vectors.join(few(asked.select(F.col("class_id").alias("id")).distinct()), "id", "left_semi"))
    result, _, left = hashed_search(vectors, wanted, dim, k, tables, hashes, width, first, most, seed, target)
    if exact and left.limit(1).count():
        settled = result.join(left.select(F.col("id").alias("query")), "query", "left_anti")
        result = settled.unionByName(top(exact_search(vectors, left, dim, k), k))
    # A class stands for its members; of each only the k + 1 smallest keys can ever be needed, and of all near members
    # only the k + 1 best, one of which may be the asking key itself.
    member = Window.partitionBy("class_id").orderBy("id")
    least = members.select("class_id", "id", F.row_number().over(member).alias("nth")).where(F.col("nth") <= k + 1).select(F.col("class_id").alias("near"), F.col("id").alias("neighbour"))
    own = wanted.select(F.col("id").alias("query"), F.col("id").alias("near"), F.lit(1.0).alias("similarity"))
    near = result.select("query", F.col("id").alias("near"), "similarity").unionByName(own).join(least, "near")
    placed = near.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("nth") <= k + 1)
    pairs = hot_join(asked.select(F.col("class_id").alias("query"), F.col("id").alias("asked")), placed.select("query", "neighbour", "similarity"), ["query"], ["asked"]).where("asked <> neighbour")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select(F.col("asked").alias("query"), F.col("neighbour").alias("id"), "similarity", "place")


def recall_report(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, queries: DataFrame | None = None, order: str | None = None, target: float = TARGET) -> DataFrame:
    """One row on hashing alone against brute force, for the distinct vectors of the queries: queries, rows, the share
    settled, recall (neighbours found of the k nearest), and the mean share of row visits (a row met in two tables counts
    twice)."""
    members, vectors = sets.classes(unit_vectors(df, key, vector, dim, order), "vec")
    asked = members if queries is None else members.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi")
    wanted = cut(vectors.join(few(asked.select(F.col("class_id").alias("id")).distinct()), "id", "left_semi"))
    result, visits, left = hashed_search(vectors, wanted, dim, k, TABLES, HASHES, WIDTH, FIRST, MOST, SEED, target)
    truth = top(exact_search(vectors, wanted, dim, k), k)
    both = truth.select("query", "id").join(result.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count(F.lit(1)).alias("true"), F.count("hit").alias("hit"))
    sizes = vectors.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(wanted.agg(F.count(F.lit(1)).alias("queries"))).crossJoin(left.agg(F.count(F.lit(1)).alias("open")))  # rows of one
    row = sizes.crossJoin(both).crossJoin(visits.agg(F.coalesce(F.sum("visited"), F.lit(0)).alias("met")))
    return row.select("queries", "vectors", F.round(1 - F.try_divide("open", "queries"), 4).alias("settled_share"), F.round(F.try_divide("hit", "true"), 4).alias("recall"), F.round(F.try_divide(F.col("met"), F.col("queries") * F.col("vectors")), 4).alias("visited_share"))

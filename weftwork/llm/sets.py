"""Texts as sets of words: classes of equal sets, minwise fingerprints, exact Jaccard similarity.

Texts with the same set of words form one class. All work on pairs is done between class representatives (the
smallest id), so copies cost one row each and never a pair; the membership table leads back to the records.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.skew import few, hot_join
from weftwork.storage import cut, discard

WORD = r"[a-z0-9]+"


def latest(df: DataFrame, key: str, *values: str, order: str | None = None) -> DataFrame:
    """One row per key: rows delivered again count once. Null keys are dropped.

    Of rows that differ, the one with the greatest ``order`` (then the greatest value) stands. Repeated keys are found on
    the keys alone; only their rows are shuffled, folded in each task first, so a key that holds a third of all rows
    moves as one row per task. All other rows stay where they were read.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *([F.col(order).alias("o")] if order else []), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])
    repeated = few(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    pick = F.struct(*[c for c in rows.columns if c != "k"])
    folded = rows.join(repeated, "k", "left_semi").groupBy("k").agg(F.max(pick).alias("m"))
    names = [F.col(f"v{k}").alias(v) for k, v in enumerate(values)]
    one = rows.join(repeated, "k", "left_anti").select(F.col("k").alias(key), *names)
    return one.unionByName(folded.select(F.col("k").alias(key), *[F.col(f"m.v{k}").alias(v) for k, v in enumerate(values)]))


def word_sets(df: DataFrame, key: str, text: str, shingle: int = 1) -> DataFrame:
    """(id, words): the distinct words of each text as sorted 64-bit hashes; texts without words take no part.

    Words are the maximal runs of a-z and 0-9 in the lower-cased text. With ``shingle`` above 1 the elements are runs
    of so many words (a text with fewer gives the one run it has).
    """
    source = df.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("text")).where(F.col("text").rlike("[a-z0-9]"))
    kind = source.schema["id"].dataType.simpleString()
    pattern = re.compile(WORD)

    def run(batches):
        for batch in batches:
            lists = []
            for t in batch.column(1).to_pylist():
                words = pattern.findall(t)
                if shingle > 1:
                    words = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
                lists.append(np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in set(words)], dtype=np.uint64).view(np.int64)))
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "words"])

    return source.mapInArrow(run, f"id {kind}, words array<long>")


def set_key(words: str = "words"):
    """Two independent 64-bit hashes of the sorted set stand for it (128 bits)."""
    return F.struct(F.xxhash64(words).alias("a"), F.xxhash64(F.lit("second"), F.col(words)).alias("b"))


def classes(rows: DataFrame, column: str = "words") -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and representatives (id, column) of (id, column), both written once.

    class_id is the smallest id with the same value (a set, a vector). Only hashes of the values are shuffled to find it;
    copies are folded in each task first, and a value that a third of all records have is cut into pieces where members
    get their class. Values move once, for representatives alone.
    """
    keyed = cut(rows.select("id", column, set_key(column).alias("set")))
    narrow = keyed.select("id", "set")
    first = cut(narrow.groupBy("set").agg(F.min("id").alias("class_id")))
    members = cut(hot_join(narrow, first, ["set"], ["id"]).select("id", "class_id"))
    representatives = cut(keyed.select("id", column).join(few(first.select(F.col("class_id").alias("id"))), "id", "left_semi"))
    discard(keyed)  # as large as the representatives
    return members, representatives


def seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of n hash functions on 64-bit words."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**64, n, dtype=np.uint64)


def minima(lists: list[np.ndarray], n: int, seed: int, slice_words: int = 4_000) -> np.ndarray:
    """For each set the n minwise hashes (32 bits each): row per set, column per hash function.

    Sets are gone through in slices of bounded size; one larger than a slice is folded piece by piece.
    """
    mul, add = seeds(n, seed)
    out = np.full((len(lists), n), np.uint32(0xFFFFFFFF), dtype=np.uint32)

    def hashed(flat: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = flat.view(np.uint64)[:, None] * mul[None, :] + add[None, :]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)).astype(np.uint32)

    begin = 0
    while begin < len(lists):
        end, held = begin, 0
        while end < len(lists) and (end == begin or held + len(lists[end]) <= slice_words):
            held += len(lists[end])
            end += 1
        if end == begin + 1 and held > slice_words:
            whole = lists[begin]
            for at in range(0, held, slice_words):
                out[begin] = np.minimum(out[begin], hashed(whole[at : at + slice_words]).min(axis=0))
        else:
            starts = np.cumsum([0, *[len(x) for x in lists[begin : end - 1]]])
            out[begin:end] = np.minimum.reduceat(hashed(np.concatenate(lists[begin:end])), starts, axis=0)
        begin = end
    return out


def packed_low_bits(mins: np.ndarray, planes: int = 1) -> np.ndarray:
    """The lowest bits of up to 128 minwise hashes as two longs for each of ``planes`` bits: a binary fingerprint.

    Two sets of Jaccard similarity J differ in each bit with probability (1 - J) / 2, and in a hash, over all its
    planes, with probability (1 - J) (1 - 2 ** -planes).
    """
    n = mins.shape[1]
    bits = np.zeros((len(mins), planes, 128), dtype=np.uint8)
    for plane in range(planes):
        bits[:, plane, :n] = (mins[:, :128] >> plane) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.int64).reshape(len(mins), 2 * planes)


def far(similarity: float, n: int, sigmas: float = 4.0, planes: int = 1) -> int:
    """The number of n minwise hashes, each cut to ``planes`` bits, in which a pair of this similarity differs at most but
    beyond ``sigmas``."""
    p = (1 - similarity) * (1 - 0.5**planes)
    return int(np.ceil(n * p + sigmas * np.sqrt(n * p * (1 - p))))


def mix_columns(columns: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of a matrix of 32-bit values."""
    key = np.full(len(columns), np.uint64(0x9E3779B97F4A7C15))
    with np.errstate(over="ignore"):
        for c in columns.T:
            key = (key ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def jaccard(a, b):
    """Exact Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def may_reach(threshold: float):
    """Whether the sets behind two sketches (n, s: 16 bits of each word, each once) can have the similarity.

    Two words of one set that share their 16 bits make its sketch smaller, so the common words are at most the common
    bits and what the smaller loss of the two sets adds: no pair that has the similarity is left out.
    """
    lost = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    both = F.least(F.size(F.array_intersect("sa", "sb")) + lost, F.col("na"), F.col("nb"))
    return both * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-6


def verified(pairs: DataFrame, representatives: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs (a, b) whose sets have at least the similarity.

    Pairs first meet sketches, a quarter of the words' size; whole words are fetched only for pairs that pass.
    """
    short = F.array_distinct(F.transform("words", lambda w: F.shiftright(w, 48).cast("short")))
    sketch = cut(representatives.select("id", F.size("words").alias("n"), short.alias("s")))
    side = lambda x: sketch.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    likely = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(may_reach(threshold)).select("a", "b"))
    needed = few(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    known = cut(representatives.join(needed, "id", "left_semi"))
    left = known.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    right = known.select(F.col("id").alias("b"), F.col("words").alias("wb"))
    both = likely.join(left, "a").join(right, "b").withColumn("similarity", jaccard(F.col("wa"), F.col("wb")))
    return both.where(F.col("similarity") >= threshold).select("a", "b", "similarity")

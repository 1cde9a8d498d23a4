"""Near-duplicate records by multi-index hashing of minwise fingerprints.

The fingerprint of a text is a row of SEGMENTS x SYMBOLS minwise symbols of its word set. Two texts of similarity J
agree in each symbol with probability J. Every segment is a table of its own; the ball of radius 1 around a segment's
value is enumerated by leaving out each symbol in turn, so two segments that differ in at most one symbol meet. What
meets must then be near over the complete fingerprint (Hamming distance of its symbols, each cut to its low bits) and,
last, reach the exact Jaccard similarity of the word sets. With 17 segments of 7 symbols a pair of similarity 0.7 meets
with probability 0.999 and one of 0.8 with more than 0.99999.

Segments are gone through in rounds, so that the disk never holds the keys of all segments at once: a round's shuffle
ends with it, and only its pairs are written.

Defined results: null texts and texts without words take no part; repeated rows count once; copies form one class and
cost no pairs until the very end; ties (exactly the threshold) belong in; other columns are ignored; empty tables give
empty results; texts are used whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import buckets, components, sets
from weftwork.operators.skew import hot_join
from weftwork.storage import cut, discard, short_shuffles

SEGMENTS, SYMBOLS, SEED = 17, 7, 20_231
#: Low bits of a symbol that are compared. With one bit, texts of similarity 0.4, which share only their common phrases,
#: pass in every second case, and their number grows with the square of the table; with three, in one of hundreds.
PLANES = 3
#: Rows (records x keys) up to which segments share a round; a larger segment has a round of its own.
ROUND = 2_000_000


def rounds(records: int) -> list[range]:
    """The segments of each round."""
    per = max(1, min(SEGMENTS, ROUND // max(1, records * SYMBOLS)))
    return [range(s, min(s + per, SEGMENTS)) for s in range(0, SEGMENTS, per)]


def segment_keys(segments: range, symbols: int = SYMBOLS) -> buckets.Keys:
    """Keys of a batch (id, signature, prints), whose signature has these segments alone: the radius-1 ball of each, and the
    complete fingerprint."""

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mins = buckets.signatures(batch)
        found = np.empty((len(mins), len(segments) * symbols), dtype=np.int64)
        for k, s in enumerate(segments):
            own = mins[:, k * symbols : (k + 1) * symbols]
            for out in range(symbols):
                place = np.full((len(mins), 1), s * symbols + out, dtype=np.uint32)
                found[:, k * symbols + out] = sets.mix_columns(np.hstack([place, np.delete(own, out, axis=1)]))
        return found, buckets.prints(batch)

    return keys


def near_classes(df: DataFrame, key: str, text: str, threshold: float = 0.7, shingle: int = 1, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id), and links (a, b, similarity) with a < b between classes of at least the threshold."""
    with short_shuffles(df.sparkSession):
        members, representatives = sets.classes(sets.word_sets(sets.latest(df, key, text, order=order), key, text, shingle))
        return members, cut(sets.verified(candidates(representatives, threshold), representatives, threshold))


def candidates(representatives: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b, each once, of the representatives (id, words) that meet in a segment and have near fingerprints."""
    signed = buckets.signed(representatives, "words", SEGMENTS * SYMBOLS, SEED, planes=PLANES)
    within = sets.far(threshold, min(128, SEGMENTS * SYMBOLS), planes=PLANES)
    total, met = signed.count(), []
    for segments in rounds(total):
        part = F.substring("signature", 4 * SYMBOLS * segments.start + 1, 4 * SYMBOLS * len(segments))
        met.append(cut(buckets.self_pairs(signed.select("id", part.alias("signature"), "prints"), segment_keys(segments), within, planes=PLANES, total=total)))
    pairs = cut(reduce(DataFrame.unionByName, met).distinct())
    for held in (signed, *met):
        discard(held)
    return pairs


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) of records, a < b: links between classes carried to their members, and copies.

    A class that a third of all records are in is cut into pieces; its pairs are listed all the same.
    """
    left = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    half = cut(hot_join(left, links.select("a", "b"), ["a"], ["x"]).select("b", "x"))
    between = hot_join(right, half, ["b"], ["y"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    several = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    copied = cut(members.join(several, "class_id", "left_semi").select("class_id", "id"))
    copies = hot_join(copied.withColumnRenamed("id", "a"), copied.withColumnRenamed("id", "b"), ["class_id"], ["a"]).where("a < b").select("a", "b")
    return between.unionByName(copies)


def near_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links): one row per record. group_id is the least id linked over any chain; links is
    the number of other classes its class is linked to."""
    linked = components.of_pairs(links).select(F.col("id").alias("class_id"), F.col("component"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    known = cut(linked.join(degree, "class_id"))
    return (
        hot_join(members, known, ["class_id"], ["id"], "left")
        .select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )

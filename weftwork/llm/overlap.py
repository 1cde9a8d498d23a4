"""Records of the evaluation splits that stand, exactly or almost, in the training split.

Minwise signatures of the word sets are cut into bands; only buckets where a training record meets an evaluation
record of the same scale give candidates. The signature's low bits drop distant candidates before the exact Jaccard
similarity is taken. With 56 bands of 6 rows a pair of similarity 0.7 meets with probability 0.999.

Defined results: split names are read without case and outer blanks, ``val``, ``valid``, ``dev`` and ``eval`` mean
validation, ``training`` and ``testing`` likewise; rows with another or no split, without scale or product take no
part; a product delivered again counts once per scale and split; null texts and texts without words take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import split_name
from weftwork.llm import buckets, sets
from weftwork.operators.skew import hot_join
from weftwork.storage import cut

BANDS, ROWS, SEED = 56, 6, 40_927


def memberships(df: DataFrame, scale: str = "scale", split: str = "split", key: str = "product_id") -> DataFrame:
    """(scale, split, id), each once."""
    return df.select(F.col(scale).alias("scale"), split_name(split).alias("split"), F.col(key).alias("id")).dropna().distinct()


def band_keys(bands: int = BANDS, rows: int = ROWS) -> buckets.Keys:
    """Keys of a batch (id, signature, ...): one bucket of each band, and the low bits of the first 128 hashes."""

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mins = buckets.signatures(batch)
        found = np.empty((len(mins), bands), dtype=np.int64)
        for b in range(bands):
            found[:, b] = sets.mix_columns(np.hstack([np.full((len(mins), 1), b, dtype=np.uint32), mins[:, b * rows : (b + 1) * rows]]))
        return found, sets.packed_low_bits(mins)

    return keys


def cross_split_pairs(records: DataFrame, key: str, text: str, member: DataFrame, threshold: float = 0.7, shingle: int = 1, order: str | None = None) -> DataFrame:
    """(scale, split, train_id, id): evaluation record ``id`` of ``split`` stands almost or exactly at ``train_id``.

    ``member`` is (scale, split, id) as from ``memberships``.
    """
    classed, representatives = sets.classes(sets.word_sets(sets.latest(records, key, text, order=order), key, text, shingle))
    placed = cut(classed.join(member, "id").select("scale", "split", "id", "class_id"))
    # A bit for each scale (several may share one: that only lets more candidates through) where a class has records in
    # training, and where in evaluation.
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(scale), 62) AS INT))")
    trains, zero = F.col("split") == "train", F.lit(0).cast("long")
    sides = cut(placed.groupBy("class_id").agg(F.bit_or(F.when(trains, bit).otherwise(zero)).alias("t"), F.bit_or(F.when(trains, zero).otherwise(bit)).alias("e")))
    sided = representatives.join(sides.withColumnRenamed("class_id", "id"), "id")
    candidates = buckets.self_pairs(buckets.signed(sided, "words", BANDS * ROWS, SEED, ("t", "e")), band_keys(), sets.far(threshold, 128), ("t", "e"))
    near = cut(sets.verified(candidates, representatives, threshold).select("a", "b"))
    same = sides.where(F.col("t").bitwiseAND(F.col("e")) != 0).select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    pairs = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    train = placed.where("split = 'train'").select("scale", F.col("class_id").alias("a"), F.col("id").alias("train_id"))
    held = placed.where("split <> 'train'").select("scale", "split", F.col("class_id").alias("b"), "id")
    half = cut(hot_join(train, pairs, ["a"], ["train_id"]).select("scale", "b", "train_id"))
    return hot_join(held, half, ["scale", "b"], ["id"]).where("id <> train_id").select("scale", "split", "train_id", "id").distinct()

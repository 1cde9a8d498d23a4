"""Reproducible stratified samples and splits of a catalogue that never part a duplicate group.

Groups are ordered by a hash of seed and group, strata dealt in turn. All ordering works on one small row per group, in
pieces of bounded size (``prefix``), so that a stratum with a third of all groups is no one task's work.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.prefix import prefix

#: Groups of the order that one task splits.
RUN = 10_000


def groups(products: DataFrame, seed: int = 42) -> DataFrame:
    """(group_id, stratum, size, draw) of (product_id, image_group, stratum).

    A product without a group is its own; a group's stratum is that of its smallest product, ``Unknown`` if it has none.
    """
    group = F.coalesce("image_group", F.concat(F.lit("product:"), F.col("product_id")))
    by = products.select("product_id", group.alias("group_id"), F.coalesce("stratum", F.lit("Unknown")).alias("stratum")).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("product_id", "stratum")).alias("first"))
    return by.select("group_id", F.col("first.stratum").alias("stratum"), "size", F.sha2(F.concat_ws(":", F.lit(str(seed)), "group_id"), 256).alias("draw"))


def round_robin(grouped: DataFrame) -> DataFrame:
    """Adds ``turn``, the place of a group within its stratum; (turn, stratum) is the order of dealing."""
    pieces = grouped.withColumn("piece", F.conv(F.substring("draw", 1, 2), 16, 10).cast("int")).withColumn("one", F.lit(1).cast("long"))
    return prefix(pieces, ["stratum"], ["draw"], {"one": "turn"}, True).drop("piece", "one")


def before(dealt: DataFrame) -> DataFrame:
    """Adds ``before``, the products of all groups dealt earlier."""
    pieces = dealt.withColumn("piece", F.floor(F.col("turn") / 256).cast("int"))
    return prefix(pieces, [], ["turn", "stratum"], {"size": "before"}, False).drop("piece")


def select(dealt: DataFrame, target: int | None) -> DataFrame:
    """Groups until the target is reached; the last may overshoot it. No target takes all."""
    counted = before(dealt)
    return counted if target is None else counted.where(F.col("before") < target)


def split(selected: DataFrame, ratios: Mapping[str, float], run: int = RUN) -> DataFrame:
    """(group_id, split): each group in dealing order to the split that is filled least for its ratio.

    The order is cut into runs of about ``run`` products; each is filled for itself, so splits stay within one group
    per run of their ratio. Equally filled splits: the first of the ratios.
    """
    names, parts = list(ratios), list(ratios.values())

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "stratum"])
        held, out = [0.0] * len(names), []
        for size in rows["size"]:
            k = min(range(len(names)), key=lambda j: (held[j] / parts[j], j))
            held[k] += size
            out.append(names[k])
        return pd.DataFrame({"group_id": rows["group_id"], "split": out})

    return selected.withColumn("run", F.floor(F.col("before") / run)).groupBy("run").applyInPandas(fill, "group_id string, split string")


def memberships(products: DataFrame, scales: Mapping[str, int | None], ratios: Mapping[str, float], seed: int = 42) -> DataFrame:
    """(scale, split, product_id) for every scale."""
    dealt = round_robin(groups(products, seed))
    group = F.coalesce("image_group", F.concat(F.lit("product:"), F.col("product_id"))).alias("group_id")
    keyed = products.select("product_id", group)
    out = None
    for scale, target in scales.items():
        rows = split(select(dealt, target), ratios).join(keyed, "group_id").select(F.lit(scale).alias("scale"), "split", "product_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def invert(manifest: DataFrame) -> DataFrame:
    """(scale, product_id, split) of (scale, splits: map of split to ids); of a repeated id the last split stands."""
    places = manifest.select("scale", F.posexplode(F.map_entries("splits")).alias("at", "e")).select("scale", "at", F.col("e.key").alias("split"), F.explode("e.value").alias("product_id"))
    return places.groupBy("scale", "product_id").agg(F.max_by("split", "at").alias("split"))

"""Train, validation and test splits that keep related records together.

Records that share an entity, directly or over others, form one component (minimum-label propagation over the
bipartite record-entity graph) and get one split. Components are placed so that the label distribution of each split
deviates least from the whole: the few largest one by one, each where the squared deviation grows least; the others by
stratum of label and size in the target ratios; single records last, filling up what each split still lacks of their
label. Strata are ranked by hash in pieces of bounded size, so a label that holds a third of all records is no one
task's work, and only the components above ``GIANT`` of a part's records (at most 1 / GIANT of them) reach the driver.

Defined results: a record without an entity stands alone; null records are dropped; repeated rows count once; a null
label is a label of its own; parts (here: scales) are split apart; other columns are ignored; an empty table gives no
rows. Each part's proportions are exact to within the size of its components.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import components
from weftwork.operators.prefix import prefix
from weftwork.operators.skew import hot_join, hot_keys
from weftwork.storage import cut

NAMES, RATIOS = ("train", "validation", "test"), (0.8, 0.1, 0.1)
GIANT = 0.001
#: Counters of labels in the giants' bookkeeping (labels are hashed to them: with very many labels two may share one, and
#: are then balanced as one where giants are placed); records of a stratum ranked in one task.
LABELS, PIECE = 4_096, 50_000


def digest(column: str):
    """The 64 hexadecimal digits in a text, lower case; null where there is none."""
    found = F.regexp_extract(F.lower(column), r"(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])", 1)
    return F.when(found != "", found)


def fraction(*columns):
    """A hash of the columns as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**52)).cast("double") / float(2**52)


def ranked(rows: DataFrame, strata: list[str], key: str, seed: int) -> DataFrame:
    """Adds rank (1..n in hash order) and n within the stratum, each piece of a stratum ranked apart."""
    n = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    placed = hot_join(rows, n, strata, [key]).withColumn("at", fraction(key, F.lit(seed))).withColumn("one", F.lit(1).cast("long"))
    pieces = placed.withColumn("piece", F.floor(F.col("at") * F.ceil(F.col("n") / PIECE)).cast("int"))
    return prefix(pieces, strata, ["at", key], {"one": "rank"}, True).drop("at", "one", "piece")


def by_threshold(position, quotas: Sequence):
    """The split in whose part of the unit interval the position falls."""
    edge, out = F.lit(0.0), None
    for name, q in zip(NAMES[:-1], quotas[:-1]):
        edge = edge + q
        out = F.when(position < edge, name) if out is None else out.when(position < edge, name)
    return out.otherwise(NAMES[-1])


def place_giants(giants: list, totals: list, ratios: Sequence[float]) -> list[tuple]:
    """(part, component, split) of the largest components, largest first."""
    out = []
    whole: dict = {}
    for r in totals:
        whole.setdefault(r["part"], np.zeros(LABELS))[r["fold"]] += r["n"]
    vectors: dict = {}
    for r in giants:
        vectors.setdefault((r["part"], r["component"]), np.zeros(LABELS))[r["fold"]] += r["n"]
    held = {part: np.zeros((len(NAMES), LABELS)) for part in whole}
    for (part, component), v in sorted(vectors.items(), key=lambda x: (str(x[0][0]), -x[1].sum(), x[0][1])):
        want = np.outer(ratios, whole[part])
        weight = 1.0 / np.maximum(np.outer(ratios, whole[part]), 1.0)
        grown = ((held[part] + v - want) ** 2 * weight).sum(axis=1) - ((held[part] - want) ** 2 * weight).sum(axis=1)
        s = int(np.argmin(grown))
        held[part][s] += v
        out.append((part, component, NAMES[s]))
    return out


def assign(records: DataFrame, edges: DataFrame, ratios: Sequence[float] = RATIOS, seed: int = 11) -> DataFrame:
    """(part, id, label, component, split) for ``records`` (part, id, label) and ``edges`` (record, entity)."""
    spark = records.sparkSession
    linked = components.propagate(edges)
    own = records.where("part is not null and id is not null").groupBy("part", "id").agg(F.max("label").alias("label"))
    known = cut(own.join(linked.withColumnRenamed("record", "id"), "id", "left").select("part", "id", "label", F.coalesce("component", "id").alias("component"), F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int").alias("fold")))
    total = known.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    sizes = cut(known.groupBy("part", "component").agg(F.count(F.lit(1)).alias("size"), F.mode("label", True).alias("main")).join(total, "part"))

    large = sizes.where((F.col("size") > 1) & (F.col("size") > GIANT * F.col("total"))).select("part", "component")
    counts = known.join(large, ["part", "component"], "left_semi").groupBy("part", "component", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = known.groupBy("part", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    kinds = f"part {known.schema['part'].dataType.simpleString()}, component {known.schema['component'].dataType.simpleString()}, split string"
    giants = spark.createDataFrame(place_giants(counts, totals, ratios), kinds)

    rest = sizes.join(giants, ["part", "component"], "left_anti")
    medium = ranked(cut(rest.where("size > 1")), ["part", "main", "size"], "component", seed)
    position = (F.col("rank") - fraction("part", "main", "size", F.lit(seed))) / F.col("n")
    groups = cut(giants.unionByName(medium.select("part", "component", by_threshold(position, [F.lit(r) for r in ratios]).alias("split"))))

    hot = hot_keys(known, ["part", "component"])
    grouped = cut(hot_join(known, groups, ["part", "component"], ["id"], hot=hot))
    label = F.coalesce("label", F.lit("\0")).alias("label")
    got = grouped.groupBy("part", label).agg(*[F.count(F.when(F.col("split") == s, 1)).alias(f"g{k}") for k, s in enumerate(NAMES)])
    whole = known.groupBy("part", label).agg(F.count(F.lit(1)).alias("all"))
    lack = whole.join(got, ["part", "label"], "left").select("part", "label", *[F.greatest(F.lit(0.0), r * F.col("all") - F.coalesce(f"g{k}", F.lit(0))).alias(f"q{k}") for k, r in enumerate(ratios)])
    # What is in no group stands alone in its component, so this join has no hot keys on its own side.
    alone = cut(known.join(grouped.select("part", "id"), ["part", "id"], "left_anti").withColumn("stratum", F.coalesce("label", F.lit("\0"))))
    queued = hot_join(cut(ranked(alone, ["part", "stratum"], "id", seed)), lack.withColumnRenamed("label", "stratum"), ["part", "stratum"], ["id"])
    sum_q = F.greatest(sum((F.col(f"q{k}") for k in range(1, len(NAMES))), F.col("q0")), F.lit(1e-9))
    chosen = by_threshold((F.col("rank") - 0.5) / F.col("n"), [F.col(f"q{k}") / sum_q for k in range(len(NAMES))])
    columns = ["part", "id", "label", "component", "split"]
    return grouped.select(*columns).unionByName(queued.withColumn("split", chosen).select(*columns))


def leaks(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(part, entity): entities whose records lie in more than one split of a part.

    ``member`` is (part, split, id). Components over more than one split are found first; only their entities are
    then looked into.
    """
    linked = components.propagate(edges)
    placed = cut(member.join(linked.withColumnRenamed("record", "id"), "id"))
    torn = placed.groupBy("part", "component").agg((F.min("split") < F.max("split")).alias("torn")).where("torn").select("part", "component")
    inside = hot_join(placed, cut(torn), ["part", "component"], ["id"], "left_semi")
    per_entity = inside.join(edges.select(F.col("record").alias("id"), "entity").distinct(), "id").groupBy("part", "entity").agg((F.min("split") < F.max("split")).alias("torn"))
    return per_entity.where("torn").select("part", "entity")

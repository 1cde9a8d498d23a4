"""Connected components by iterative minimum-label propagation over a bipartite record-entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.skew import hot_join, hot_keys
from weftwork.storage import cut


def propagate(edges: DataFrame, record: str = "record", entity: str = "entity", max_rounds: int = 60) -> DataFrame:
    """(record, component): the smallest record id reachable over shared entities.

    Each round an entity takes the least label of its records, a record the least of its entities; then each label is
    replaced by its own label (pointer jumping), so long chains need few rounds. Both steps aggregate before the
    shuffle, and where a hot entity or the label of a giant component is joined back to its records, it is cut into pieces
    (``hot_join``). Each round is written to the shared folder. Edges with a null
    end are ignored; a record without edges does not come out. Nothing but the count of changed labels reaches the
    driver.
    """
    links = cut(edges.where(F.col(record).isNotNull() & F.col(entity).isNotNull()).select(F.col(record).alias("record"), F.col(entity).alias("entity")).distinct())
    # What only one record holds links nothing; such entities leave the loop at once.
    hot = hot_keys(links, ["entity"])
    several = cut(links.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity"))
    shared = cut(hot_join(links, several, ["entity"], ["record"], "left_semi", hot=hot))
    labels = cut(shared.select("record", F.col("record").alias("component")).distinct())
    for _ in range(max_rounds):
        of_entity = shared.join(labels, "record").groupBy("entity").agg(F.min("component").alias("component"))
        of_record = hot_join(shared, of_entity, ["entity"], ["record"], hot=hot).groupBy("record").agg(F.min("component").alias("near"))
        stepped = cut(labels.join(of_record, "record").select("record", F.col("component").alias("old"), F.least("component", "near").alias("new")))
        root = stepped.select(F.col("record").alias("new"), F.col("new").alias("root"))
        moved = cut(hot_join(stepped, root, ["new"], ["record"], "left").select("record", "old", F.least("new", F.coalesce("root", "new")).alias("component")))
        labels = moved.select("record", "component")
        if not moved.where(F.col("component") < F.col("old")).limit(1).count():
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    alone = links.select("record").distinct().join(labels, "record", "left_anti").select("record", F.col("record").alias("component"))
    return labels.unionByName(alone).select(F.col("record").alias(record), "component")


def of_pairs(pairs: DataFrame) -> DataFrame:
    """(id, component) of the nodes of (a, b): each pair is an entity of its two records."""
    pair = F.struct("a", "b")
    edges = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("record"), pair.alias("entity")), F.struct(F.col("b").alias("record"), pair.alias("entity")))).alias("e")).select("e.record", "e.entity")
    return propagate(edges).withColumnRenamed("record", "id")

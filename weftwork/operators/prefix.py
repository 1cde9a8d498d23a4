"""Sums over everything that comes before, in sorted order, where a group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.storage import cut

#: Rows of a group above which it is cut into value ranges of about this many rows.
HOT = 50_000


def ranges(values: DataFrame, keys: list[str], value: str, hot: int = HOT) -> DataFrame:
    """Adds ``piece``: 0 for groups of up to ``hot`` rows, else the value range, cut at approximate quantiles."""
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot)
    cuts = F.percentile_approx(value, [k / 1024 for k in range(1, 1024)], 4000)
    bounds = cut(values.join(sizes, keys).groupBy(*keys).agg(F.array_distinct(cuts).alias("bounds")))
    placed = F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col(value))), F.lit(0))
    return values.join(bounds, keys, "left").withColumn("piece", F.when(F.col("bounds").isNull(), 0).otherwise(placed)).drop("bounds")


def prefix(rows: DataFrame, keys: list[str], order: Sequence[Column | str], sums: dict[str, str], inclusive: bool) -> DataFrame:
    """Adds, under the names ``sums`` gives, the sum of a column over all rows of the group that come before.

    ``rows`` has ``piece``, which must not fall along ``order``; each piece is sorted apart, and only the sums of
    whole pieces are ordered together.
    """
    inner = Window.partitionBy(*keys, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.groupBy(*keys, "piece").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = before.select(*keys, "piece", *[F.coalesce(F.sum(f"t_{c}").over(outer), F.lit(0)).alias(f"o_{c}") for c in sums]).where("piece > 0")
    joined = rows.select("*", *[(F.sum(c).over(inner) - (F.lit(0) if inclusive else F.col(c))).alias(f"i_{c}") for c in sums]).join(offsets, [*keys, "piece"], "left")
    return joined.select(*rows.columns, *[(F.col(f"i_{c}") + F.coalesce(f"o_{c}", F.lit(0))).alias(name) for c, name in sums.items()])

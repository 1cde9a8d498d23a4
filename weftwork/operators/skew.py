"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.storage import cut

#: Rows of a key above which it is cut into pieces of about this size; hot keys that may be sent to every task.
PIECE, MOST_HOT = 50_000, 100_000


def hot_keys(rows: DataFrame, on: Sequence[str], piece: int | None = None) -> tuple[DataFrame, int]:
    """(on, pieces) of the keys with more than ``piece`` rows, and how many they are.

    Counts are aggregated in the tasks first, so a hot key moves as one row per task. At most rows / piece keys are hot.
    """
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    size = PIECE if piece is None else piece
    hot = cut(counted.where(F.col("n") > size).select(*on, F.ceil(F.col("n") / size).cast("int").alias("pieces")))
    return hot, hot.count()


def hot_join(rows: DataFrame, other: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", piece: int | None = None, hot: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``rows.join(other, on, how)`` (inner, left or left_semi), with the hot keys of ``rows`` cut into pieces.

    Each row of a hot key goes to the piece its ``spread`` columns hash to, the other side's rows of that key to every
    piece; all other keys are joined as they are. ``rows`` is read twice: it should be written or cheap. Without hot keys
    it is the plain join. Rows with a null key match nothing, as in any join. ``hot`` is what ``hot_keys`` gave for the
    same rows, where they are joined again and again.
    """
    hot, n = hot or hot_keys(rows, on, piece)
    if not n:
        return rows.join(other, list(on), how)
    sent = F.broadcast(hot) if n <= MOST_HOT else hot
    pieces = F.coalesce("pieces", F.lit(1))
    left = rows.join(sent, list(on), "left").withColumn("_piece", F.pmod(F.xxhash64(*spread), pieces).cast("int")).drop("pieces")
    right = other.join(sent, list(on), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return left.join(right, [*on, "_piece"], how).drop("_piece")


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Narrow rows for a semi-join: written, counted, and sent to every task only if there are at most ``most``."""
    held = cut(ids)
    return F.broadcast(held) if held.count() <= most else held

"""One ranking from several scores of different scales: outranking net flow on percentiles.

Within a group (a query) each score is turned into its mid-rank, so its scale and distribution no longer matter. One
item is preferred to another on a score by a function of the difference of their percentiles: 0 up to ``indifference``,
1 from ``preference`` on, linear between (with both 0: 1 for any difference). An item's positive flow sums its
preference over all others, its negative flow theirs over it. Both come exactly from sorted prefix sums of integer
ranks, without forming pairs. The net flow is the weighted sum of positive minus negative flows over n - 1.

Hot groups: equal values are folded before any sort, and a group of more than ``HOT`` items is cut into value ranges
that are sorted apart and joined by the sums of the ranges before them.

Defined results: a null, NaN or missing score lies below any number, and two of them are equal; repeated rows count once
(the greatest value per group and item stands); rows with a null group or item are dropped; a group of one item has net
flow 0; ties in net flow go to the smaller item; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators.prefix import HOT, prefix, ranges
from weftwork.storage import cut

LOWEST, MISSING = -1.7976931348623157e308, float("-inf")


def number(text: Column) -> Column:
    return text.try_cast("double")


def known(score: Column) -> Column:
    """The score as double, below any number where it is null or NaN."""
    x = score.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(F.greatest(x, F.lit(LOWEST)))


def wide(df: DataFrame, group: str, item: str, scores: dict[str, Column]) -> DataFrame:
    """(group, item, s0, s1, ...): one row per item of a group."""
    picked = df.select(F.col(group).alias("group"), F.col(item).alias("item"), *[known(c).alias(f"s{k}") for k, c in enumerate(scores.values())]).dropna(subset=["group", "item"])
    return picked.groupBy("group", "item").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(len(scores))])


def ranked_values(items: DataFrame, count: int, hot: int = HOT) -> DataFrame:
    """(group, score, value, c, below, n): distinct values, how many items have them, and how many lie below."""
    long = items.select("group", F.posexplode(F.array(*[f"s{k}" for k in range(count)])).alias("score", "value"))
    values = long.groupBy("group", "score", "value").agg(F.count(F.lit(1)).alias("c"))
    n = items.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return prefix(ranges(values, ["group", "score"], "value", hot), ["group", "score"], ["value"], {"c": "below"}, False).drop("piece").join(n, "group")


def value_flows(ranked: DataFrame, indifference: float, preference: float, hot: int = HOT) -> DataFrame:
    """(group, score, value, plus, minus): the flows of each distinct value, as numbers of items."""
    if preference <= indifference:
        if preference or indifference:
            raise ValueError("preference must lie above indifference, or both be 0")
        return ranked.select("group", "score", "value", F.col("below").cast("double").alias("plus"), (F.col("n") - F.col("below") - F.col("c")).cast("double").alias("minus"))
    keys = ["group", "score"]
    x = 2 * F.col("below") + F.col("c") - 1  # twice the mid-rank: whole numbers from 0 to 2 (n - 1)
    unit = 2.0 * (F.col("n") - 1)
    placed = ranked.select(*keys, "value", "n", "c", x.alias("x"), (unit * preference).alias("p"), (unit * indifference).alias("q"))
    at = {"dp": F.col("x") - F.col("p"), "dq": F.col("x") - F.col("q"), "uq": F.col("x") + F.col("q"), "up": F.col("x") + F.col("p")}
    events = [F.struct(F.col("x").cast("double").alias("t"), F.lit("").alias("kind"), F.col("c").alias("c"), (F.col("c") * F.col("x")).alias("cx"))]
    events += [F.struct(t.cast("double").alias("t"), F.lit(k).alias("kind"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("cx")) for k, t in at.items()]
    swept = placed.select(*keys, "value", "n", F.explode(F.array(*events)).alias("e")).select(*keys, "value", "n", "e.t", "e.kind", "e.c", "e.cx")
    pieces = F.ceil(F.col("n") / hot)
    swept = swept.withColumn("piece", F.greatest(F.lit(0), F.least(pieces - 1, F.floor(F.col("t") / F.greatest(2 * F.col("n"), F.lit(1)) * pieces))).cast("int"))
    sums = prefix(swept, keys, ["t", "kind"], {"c": "A", "cx": "S"}, True).where("kind <> ''")
    by = sums.groupBy(*keys, "value").agg(*[F.max(F.when(F.col("kind") == k, F.col(s))).alias(f"{s}_{k}") for k in at for s in ("A", "S")])
    both = placed.join(by, [*keys, "value"])
    slope = F.col("p") - F.col("q")
    plus = F.col("A_dp") + ((F.col("A_dq") - F.col("A_dp")) * at["dq"] - (F.col("S_dq") - F.col("S_dp"))) / slope
    minus = (F.col("n") - F.col("A_up")) + ((F.col("S_up") - F.col("S_uq")) - (F.col("A_up") - F.col("A_uq")) * at["uq"]) / slope
    alone = F.col("n") < 2
    return both.select(*keys, "value", F.when(alone, 0.0).otherwise(plus).alias("plus"), F.when(alone, 0.0).otherwise(minus).alias("minus"))


def net_flows(items: DataFrame, weights: Sequence[float], indifference: float = 0.0, preference: float = 0.0, hot: int = HOT) -> DataFrame:
    """``items`` of ``wide`` with n, positive, negative and net_flow, rounded to 9 places."""
    count, total = len(weights), float(sum(weights))
    if min(weights) < 0 or not total:
        raise ValueError("weights must not be negative, nor all 0")
    ranked = ranked_values(items, count, hot)
    flows = value_flows(ranked, indifference, preference, hot)
    long = items.select("group", "item", F.posexplode(F.array(*[f"s{k}" for k in range(count)])).alias("score", "value"))
    weight = F.element_at(F.array(*[F.lit(w / total) for w in weights]), F.col("score") + 1)
    per_item = long.join(flows, ["group", "score", "value"]).groupBy("group", "item").agg(F.sum(weight * F.col("plus")).alias("plus"), F.sum(weight * F.col("minus")).alias("minus"))
    others = F.greatest(F.col("n") - 1, F.lit(1))
    n = items.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    share = per_item.join(n, "group").select("group", "item", "n", F.round(F.col("plus") / others, 9).alias("positive"), F.round(F.col("minus") / others, 9).alias("negative"))
    return items.join(share, ["group", "item"]).withColumn("net_flow", F.round(F.col("positive") - F.col("negative"), 9))


def ranking(df: DataFrame, group: str, item: str, scores: dict[str, Column], weights: Sequence[float] | None = None, indifference: float = 0.02, preference: float = 0.25, hot: int = HOT) -> DataFrame:
    """(group, item, position, net_flow, positive, negative), position 1 the best of its group."""
    flows = cut(net_flows(cut(wide(df, group, item, scores)), weights or [1.0] * len(scores), indifference, preference, hot))
    rows = flows.select("group", "item", "net_flow", "positive", "negative", (-F.col("net_flow")).alias("low"), F.lit(1).cast("long").alias("one"))
    placed = prefix(ranges(rows, ["group"], "low", hot), ["group"], ["low", "item"], {"one": "position"}, True)
    return placed.select(F.col("group").alias(group), F.col("item").alias(item), F.col("position").cast("long"), "net_flow", "positive", "negative")


def majority(a, b, count: int) -> Column:
    """Scores in which a is greater than b, less those in which b is greater than a."""
    total = F.lit(0)
    for k in range(count):
        x, y = a(f"s{k}"), b(f"s{k}")
        total = total + F.when(x > y, 1).when(x < y, -1).otherwise(0)
    return total


def undefeated(df: DataFrame, group: str, item: str, scores: dict[str, Column], chunk: int = 500, hot: int = HOT) -> DataFrame:
    """(group, item): the item, if any, that beats every other of its group by the majority of scores.

    Such an item has a net flow (equal weights, any difference counts) of at least 1 / len(scores): summed over the
    others, it wins at least one score more than it loses. So the net flows give the candidates. Candidates then play
    knock-out rounds in chunks of bounded size (an item that beats all others survives any order of play), and the one
    left is held against its whole group. No step forms pairs within a group.
    """
    count = len(scores)
    flows = cut(net_flows(cut(wide(df, group, item, scores)), [1.0] * count, hot=hot))
    fields = ["item", *[f"s{k}" for k in range(count)]]
    left = flows.where((F.col("n") == 1) | (F.col("net_flow") * count * (F.col("n") - 1) >= (F.col("n") - 1) * (1 - 1e-6) - 1e-6)).select("group", *fields)
    kind = ", ".join(f"{f}: {t}" for f, t in left.dtypes if f != "group")

    def play(a: Column, b: Column) -> Column:
        won = majority(lambda f: a[f], lambda f: b[f], count)
        return F.when(a.isNull() | (won < 0), b).when(won > 0, a)

    while True:
        sized = left.join(left.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "group")
        rounds = sized.withColumn("chunk", F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / chunk)))
        played = rounds.groupBy("group", "chunk").agg(F.collect_list(F.struct(*fields)).alias("all"))
        best = played.select("group", F.reduce("all", F.lit(None).cast(f"struct<{kind}>"), play).alias("best")).where("best is not null")
        left = cut(best.select("group", "best.*"))
        if not left.groupBy("group").count().where("count > 1").limit(1).count():
            break
    champion = left.select("group", F.col("item").alias("top"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(count)])
    won = majority(lambda f: F.col("t" + f[1:]), F.col, count)
    held = flows.join(champion, "group").groupBy("group", "top").agg(F.min(F.when(F.col("item") == F.col("top"), True).otherwise(won > 0)).alias("all_beaten"))
    return held.where("all_beaten").select(F.col("group").alias(group), F.col("top").alias(item))

"""Mixing sources to target shares by the cube method of balanced sampling.

Every source wants ``target_share`` of the tokens of all records, but can give no more than ``max_repeats`` times its
own. Wanted over own tokens is the number of uses per record; its whole part is used for certain, the fraction is an
inclusion probability. The flight phase moves probabilities along the null space of two constraints, the tokens and
the number of records, until they are 0 or 1; each step takes three undecided records, so it is linear. Blocks of
bounded size fly apart, each leaves at most two records undecided, and these fly on together. The landing phase decides
the last few of a source by the choice that lies nearest to its tokens.

Defined results: sources are read without case and outer blanks; records with a null or unknown source count in the
total but are never used; null and empty texts have no tokens and are never used; rows delivered again count once;
a source of the targets without records is reported with 0; repeated targets count once (the greatest row stands);
other columns are ignored; an empty table reports every source with 0 and no shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import tokens
from weftwork.llm.sets import latest
from weftwork.storage import cut

#: Records that fly together in one task.
BLOCK = 20_000
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight phase: all but at most two are 0 or 1.

    sum(p) and sum(p * size) stay what they were.
    """
    p = p.tolist()
    size = size.tolist()
    chance = rng.random(len(p) + 8).tolist()
    active: list[int] = []
    step = 0
    for unit in range(len(p)):
        if not EPS < p[unit] < 1 - EPS:
            p[unit] = float(p[unit] > 0.5)
            continue
        active.append(unit)
        if len(active) < 3:
            continue
        i, j, k = active
        u = (size[j] - size[k], size[k] - size[i], size[i] - size[j])
        if not any(u):
            u = (1, -1, 0)
        up = down = float("inf")
        for x, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, p[x] / -d), min(down, (1 - p[x]) / -d)
        move = up if chance[step] * (up + down) < down else -down
        step += 1
        for x, d in zip(active, u):
            p[x] += move * d
        active = [x for x in active if EPS < p[x] < 1 - EPS]
        for x in (i, j, k):
            if x not in active:
                p[x] = float(p[x] > 0.5)
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the undecided (a few): of all choices the one nearest in tokens, then in records."""
    p = p.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(open_):
        return p
    choices = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(choices @ size[open_] - p[open_] @ size[open_])
    off_count = np.abs(choices.sum(axis=1) - p[open_].sum())
    p[open_] = choices[np.lexsort((off_count, off))[0]]
    return p


def sized(df: DataFrame, key: str, text: str, source: str, tokenizer: str = tokens.DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(id, source, n_tokens), one row per key."""
    one = latest(df, key, text, source)
    counted = one.select(F.struct(F.col(key).alias("id"), F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))).alias("source")).alias("record"), F.col(text).alias("text"))
    return tokens.count(counted, "record", "text", tokenizer, folder).select("record.id", "record.source", "n_tokens")


def wanted(records: DataFrame, targets: DataFrame) -> DataFrame:
    """A row per source of the targets: its tokens, what it wants, what it gets at most, uses per record."""
    goal = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats")).where("source is not null")
    goal = goal.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.*")
    own = records.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    whole = records.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))  # one row
    row = goal.join(own, "source", "left").crossJoin(F.broadcast(whole)).withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
    most = F.col("own_tokens") * F.coalesce("max_repeats", F.lit(0))
    want = F.coalesce("target_share", F.lit(0.0)) * F.col("all_tokens")
    uses = F.when(F.col("own_tokens") > 0, F.least(most.cast("double"), want) / F.col("own_tokens")).otherwise(0.0)
    return row.select("source", "target_share", "max_repeats", "own_tokens", "all_tokens", want.alias("wanted_tokens"), most.alias("most_tokens"), (most < want).alias("short"), uses.alias("uses"))


def fly(undecided: DataFrame, last: bool, seed: int, round_: int) -> DataFrame:
    id_kind = undecided.schema["id"].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        name = f"{seed}|{round_}|{block['source'].iloc[0]}|{block['block'].iloc[0]}"
        rng = np.random.default_rng(list(name.encode()))
        size = block["n_tokens"].to_numpy(np.int64)
        p = flight(block["p"].to_numpy(float), size, rng)
        return block.assign(p=landing(p, size) if last else p)[["id", "source", "n_tokens", "p"]]

    return undecided.groupBy("source", "block").applyInPandas(run, f"id {id_kind}, source string, n_tokens long, p double")


def mix(records: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, source, n_tokens, copies) of the records of known sources, and the shares of each source.

    ``records`` is (id, source, n_tokens). Shares: what was wanted, what is reached, and ``short`` for a source that
    can't reach its share.
    """
    records = cut(records)
    plan = cut(wanted(records, targets))
    usable = cut(records.where("n_tokens > 0").join(plan.select("source", "uses"), "source").select("id", "source", "n_tokens", F.floor(F.col("uses") + EPS).alias("base"), (F.col("uses") - F.floor(F.col("uses") + EPS)).alias("p")))
    undecided = usable.where(F.col("p") > EPS).select("id", "source", "n_tokens", "p")
    decided = None
    round_ = 0
    while True:
        count = undecided.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        last = most <= block
        placed = undecided.join(count, "source").withColumn("block", F.pmod(F.xxhash64("id", F.lit(round_)), F.ceil(F.col("n") / block))).drop("n")
        flown = cut(fly(placed, last, seed, round_))
        done = flown if last else flown.where(~F.col("p").between(EPS, 1 - EPS))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        undecided, round_ = flown.where(F.col("p").between(EPS, 1 - EPS)), round_ + 1
    copies = usable.join(decided.select("id", F.round("p").cast("long").alias("extra")), "id", "left")
    chosen = cut(copies.select("id", "source", "n_tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies")))
    got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_records"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mixed_tokens").alias("mix_tokens"))  # one row
    zero = F.lit(0).cast("long")
    shares = plan.join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "own_tokens", "wanted_tokens", "short",
        F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), F.coalesce("mixed_records", zero).alias("mixed_records"), F.coalesce("most_copies", zero).alias("most_copies"),
        F.try_divide(F.coalesce("mixed_tokens", zero), F.col("all_tokens")).alias("reached_share"), F.try_divide(F.coalesce("mixed_tokens", zero), F.col("mix_tokens")).alias("actual_share"),
    )
    return chosen, shares

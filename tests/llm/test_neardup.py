import os
import random
import re
import time

import numpy as np
import pytest

from weftwork.llm import buckets, components, neardup, overlap, sets
from weftwork.storage import cut, discard


def corpus(n=220, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = {}
    for k in range(n):
        if k > 20 and r.random() < 0.45:
            words = rows[r.randrange(k)].split()
            for _ in range(r.randrange(0, 14)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            r.shuffle(words)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randrange(15, 60))]
        rows[k] = " ".join(words).upper() if r.random() < 0.3 else ", ".join(words)
    rows[n] = rows[n + 1] = "only"
    return rows


def brute(rows, threshold, shingle=1):
    s = {}
    for k, t in rows.items():
        words = re.findall("[a-z0-9]+", (t or "").lower())
        if shingle > 1 and words:
            words = [" ".join(words[j : j + shingle]) for j in range(max(1, len(words) - shingle + 1))]
        if words:
            s[k] = set(words)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def table(spark, rows, again=()):
    return spark.createDataFrame([(k, t, "z", 1) for k, t in [*rows.items(), *again]], "pid long, body string, words string, class_id int")


@pytest.mark.parametrize("threshold, shingle", [(0.7, 1), (0.8, 1), (0.8, 5)])
def test_pairs_against_brute_force(spark, threshold, shingle):
    rows = corpus() | {900: None, 901: "  ", 902: "ÄÖ--", 903: "w1 " * 5000 + " ".join(f"w{k}" for k in range(400))}
    members, links = neardup.near_classes(table(spark, rows, [(5, rows[5])]), "pid", "body", threshold, shingle)
    got = {(r.a, r.b) for r in neardup.near_pairs(members, links).collect()}
    assert got == brute(rows, threshold, shingle)


def test_rounds_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROUND", 1)
    assert [len(x) for x in neardup.rounds(200)] == [1] * neardup.SEGMENTS
    rows = corpus()
    members, links = neardup.near_classes(table(spark, rows), "pid", "body", 0.7)
    assert {(r.a, r.b) for r in neardup.near_pairs(members, links).collect()} == brute(rows, 0.7)


def test_common_phrases_make_few_candidates(spark, monkeypatch):
    r = random.Random(4)
    common, real, seen = [f"c{k}" for k in range(60)], sets.verified, []
    rows = {k: " ".join(r.sample(common, 48) + [f"w{k}x{j}" for j in range(20)]) for k in range(400)}  # similarity 0.4
    monkeypatch.setattr(sets, "verified", lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest))
    assert neardup.near_classes(table(spark, rows), "pid", "body", 0.7)[1].count() == len(brute(rows, 0.7))
    assert seen[0] < 0.02 * 400 * 399 / 2


def test_no_round_leaves_its_shuffle(spark):
    def held():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}

    before, until = held(), time.time() + 20
    neardup.near_classes(table(spark, corpus()), "pid", "body", 0.7)
    while (left := held() - before) and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not left


def test_discard_deletes_the_files_of_a_table(spark):
    kept, gone = cut(spark.range(5)), cut(spark.range(7))
    path = lambda df: df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    discard(gone)
    assert not os.path.exists(path(gone)) and os.path.exists(path(kept)) and kept.count() == 5
    discard(spark.range(3).localCheckpoint())


@pytest.mark.parametrize("planes, sizes", [(1, (130,)), (3, (130, 60, 20))])
def test_long_runs_are_compared_whole(spark, planes, sizes):
    r = np.random.default_rng(8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    low = r.integers(0, 2**62, (len(of), 2 * planes)) & r.integers(0, 2**62, (len(of), 2 * planes))

    def keys(batch):
        n = batch.column("id").to_numpy()
        return of[n, None].astype(np.int64) * 1024, low[n]

    apart = lambda a, b: sum(int(np.bitwise_or.reduce(low[a, h::2] ^ low[b, h::2])).bit_count() for h in (0, 1))
    within = 44 if planes == 1 else 84
    want = {(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if of[a] == of[b] and apart(a, b) <= within}
    for piece in (None, 25):
        got = [(x.a, x.b) for x in buckets.self_pairs(spark.range(len(of)), keys, within, piece=piece, planes=planes).collect()]
        assert set(got) == want and len(got) == len(want) and 0 < len(want) < sum(n * (n - 1) // 2 for n in sizes)


def test_groups(spark):
    rows = corpus()
    members, links = neardup.near_classes(table(spark, rows), "pid", "body", 0.7)
    got = {r.id: r.group_id for r in neardup.near_groups(members, links).collect()}
    label = {k: k for k in rows}
    for _ in range(len(rows)):
        for a, b in brute(rows, 0.7):
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def planted_keys(batch):
    """Key 1 and fingerprint 0 for ids below 60, key 2 and far fingerprints up to 100, keys of their own beyond."""
    n = np.array([int(str(k).strip("r")) for k in batch.column("id").to_pylist()])
    keys = np.stack([np.where(n < 60, 1, np.where(n < 100, 2, 1000 + n)), np.where(n < 100, 5000 + n, 9000 + n // 2)], axis=1)
    low = np.stack([np.where((n >= 60) & (n < 100), n * 1_000_003, 0), np.zeros_like(n)], axis=1)
    return keys.astype(np.int64) * 1024, low.astype(np.int64)  # keys are hashes: two bits of them are not used


@pytest.mark.parametrize("piece, kind", [(7, "long"), (7, "string"), (100_000, "long")])
def test_hot_buckets_are_cut_and_lose_nothing(spark, piece, kind):
    records = spark.range(180).selectExpr("id" if kind == "long" else "concat('r', lpad(id, 3, '0')) AS id", "CAST(id % 2 AS long) AS t", "CAST(1 - id % 2 AS long) AS e")
    name = int if kind == "long" else lambda k: f"r{k:03d}"
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(k, k + 1) for k in range(100, 180, 2)}
    got = [(r.a, r.b) for r in buckets.self_pairs(records, planted_keys, 0, piece=piece).collect()]
    assert len(got) == len(set(got)) and set(got) == {(name(a), name(b)) for a, b in want}
    crossed = {(r.a, r.b) for r in buckets.self_pairs(records, planted_keys, 0, ("t", "e"), piece=piece).collect()}
    assert crossed == {(name(a), name(b)) for a, b in want if (a + b) % 2}


def test_no_task_holds_more_than_a_piece_of_a_hot_bucket(spark):
    records = spark.range(0, 180, 1, 3)
    hot = buckets.hot_buckets(records, planted_keys, 180, 10)
    assert {1024, 2048} <= set(hot[0].tolist())
    rows = buckets.bucketed(records, planted_keys, hot, []).where("key & 3 = 1")
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] <= 30


def test_sketches_leave_no_pair_out(spark):
    r = np.random.default_rng(5)
    base = [sorted(set(int(x) << 46 for x in r.integers(0, 4000, 60))) for _ in range(12)]  # many words share 16 bits
    rows = [(k, sorted(set(base[k % 12][: 60 - k // 12] + [int(x) << 46 for x in r.integers(0, 4000, k // 12)]))) for k in range(72)]
    sets_ = spark.createDataFrame(rows, "id long, words array<long>")
    pairs = spark.createDataFrame([(a, b) for a in range(72) for b in range(a + 1, 72)], "a long, b long")
    got = {(x.a, x.b) for x in sets.verified(pairs, sets_, 0.7).collect()}
    w = {k: set(v) for k, v in rows}
    assert got == {(a, b) for a in w for b in w if a < b and len(w[a] & w[b]) / len(w[a] | w[b]) >= 0.7} and got


def test_latest_takes_one_row_of_each_key(spark):
    rows = [(k, f"t{k}", 1) for k in range(30)] + [(7, "new", 5), (7, "old", 0), (8, None, 9), (None, "x", 1)] + [(9, "t9", 1)] * 40
    df = spark.createDataFrame(rows, "k long, v string, k2 int")
    got = {r.k: r.v for r in sets.latest(df, "k", "v", order="k2").collect()}
    assert got == {k: f"t{k}" for k in range(30)} | {7: "new", 8: None}
    assert sets.latest(df.where("false"), "k", "v").count() == 0


def test_a_third_of_copies(spark):
    rows = {k: "alpha beta gamma delta" for k in range(40)} | {k: f"x{k} y{k} z{k}" for k in range(40, 120)}
    members, links = neardup.near_classes(table(spark, rows), "pid", "body", 0.7)
    assert links.count() == 0 and neardup.near_pairs(members, links).count() == 40 * 39 // 2
    assert {r.class_id for r in members.collect() if r.id < 40} == {0}


def test_fingerprints_estimate_similarity():
    r = np.random.default_rng(0)
    base = r.integers(-(2**62), 2**62, 100)
    a, b = np.unique(base[:85]), np.unique(base[15:])  # 70 of 100 in common
    mins = sets.minima([a, b], 2_000, 1)
    assert abs((mins[0] == mins[1]).mean() - 0.7) < 0.04
    assert (sets.minima([a], 64, 1, slice_words=7) == sets.minima([a], 64, 1)).all()
    low = sets.packed_low_bits(sets.minima([a, b], 128, 1)).view(np.uint64)
    assert sum(int(x).bit_count() for x in low[0] ^ low[1]) <= sets.far(0.7, 128)


def test_components_of_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")
    assert {r.id: r.component for r in components.of_pairs(pairs).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_empty(spark):
    members, links = neardup.near_classes(table(spark, {}), "pid", "body")
    assert neardup.near_pairs(members, links).count() == 0 and neardup.near_groups(members, links).count() == 0


MEMBERS = "scale string, split string, product_id long"


def test_overlaps_against_brute_force(spark):
    rows = corpus() | {900: None}
    r = random.Random(9)
    split = {k: r.choice(["train", " Train", "VAL", "test ", "Validation"]) for k in rows}
    placed = [("full", split[k], k) for k in rows] + [("1k", split[k], k) for k in rows if k % 3] + [("full", split[0].upper(), 0), (None, "train", 1), ("full", None, 2), ("full", "odd", 3), ("full", "train", None)]
    member = overlap.memberships(spark.createDataFrame(placed, MEMBERS))
    got = {tuple(x) for x in overlap.cross_split_pairs(table(spark, rows), "pid", "body", member).collect()}
    short = {"train": "train", "val": "validation", "validation": "validation", "test": "test"}
    name = {k: short[split[k].strip().lower()] for k in rows}
    want = set()
    for a, b in brute(rows, 0.7):
        for scale, inside in (("full", lambda k: True), ("1k", lambda k: k % 3)):
            for t, e in ((a, b), (b, a)):
                if inside(a) and inside(b) and name[t] == "train" and name[e] != "train":
                    want.add((scale, name[e], t, e))
    assert got == want and want


def test_no_overlap_without_members(spark):
    member = overlap.memberships(spark.createDataFrame([], MEMBERS))
    assert overlap.cross_split_pairs(table(spark, corpus(30)), "pid", "body", member).count() == 0

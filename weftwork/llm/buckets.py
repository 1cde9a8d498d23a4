"""Pairs of records that meet in hash buckets, where a bucket may hold a third of all rows.

One shuffle by key: each task then goes through its sorted rows and pairs the runs of equal keys in numpy. Buckets that
may hold more than ``PIECE`` records are found beforehand from the tasks' own counts and cut: such a record goes to one
piece of the bucket on the left and passes all pieces on the right, so no task holds more than a piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import sets
from weftwork.storage import cut

#: Records of a bucket above which it is cut; records that a task counts together; hot keys sent to every task at most.
PIECE, COUNTED, MOST_HOT = 2_000, 20_000, 1_000_000
#: Pairs that a task compares at once.
PAIRS = 2_000_000

#: Records of a bucket from which its pairs are compared as blocks, and a block's sides (its arrays stay in the cache).
LONG, BLOCK = 48, (64, 1024)

#: Takes an Arrow batch of records and gives keys (records x keys; hashes, whose last two bits are not used) and packed
#: fingerprints (records x 2 for each plane).
Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as numpy arrays."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def signed(records: DataFrame, words: str, n: int, seed: int, carried: tuple[str, ...] = (), planes: int = 0) -> DataFrame:
    """(id, signature, carried): n minwise hashes of each record's set, packed and written once.

    With ``planes`` also prints: the fingerprint of so many planes, so that a round that takes only a part of the
    signature has it all the same.
    """
    kind = records.schema["id"].dataType.simpleString()
    packed_rows = lambda rows: pa.array([row.tobytes() for row in rows], pa.binary())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                mins = sets.minima(arrays_of(part.column(1)), n, seed)
                prints = [packed_rows(sets.packed_low_bits(mins, planes))] if planes else []
                yield pa.RecordBatch.from_arrays([part.column(0), packed_rows(mins), *part.columns[2:], *prints], ["id", "signature", *carried, *["prints"] * bool(planes)])

    return cut(records.select("id", words, *carried).mapInArrow(run, f"id {kind}, signature binary" + "".join(f", {c} long" for c in carried) + ", prints binary" * bool(planes)))


def signatures(batch: pa.RecordBatch) -> np.ndarray:
    """The minwise hashes of a batch, a row per record."""
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)


def prints(batch: pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a batch, a row per record."""
    return np.frombuffer(b"".join(batch.column("prints").to_pylist()), dtype=np.int64).reshape(batch.num_rows, -1)


def hot_buckets(records: DataFrame, keys: Keys, total: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) that may be at more than ``piece`` of the ``total`` records, and into how many pieces to cut them.

    A task reports a key whose share of the records it counts together is at least piece / total: a key above ``piece``
    has that share in at least one task, so none is missed. Where more than ``MOST_HOT`` keys are reported, the piece is
    doubled until they fit, for at most (records x keys) / piece keys can be hot.
    """

    def run(batches):
        held: list[np.ndarray] = []

        def report():
            found, n = np.unique(np.concatenate([k.ravel() for k in held]), return_counts=True)
            share = n / sum(map(len, held))
            hot = (share >= piece / total) & (n > 1)
            return pa.RecordBatch.from_arrays([pa.array(found[hot]), pa.array(share[hot])], ["key", "share"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held.append(keys(batch.slice(at, 500))[0])
                if sum(map(len, held)) >= COUNTED:
                    yield report()
                    held = []
        if held:
            yield report()

    shares = cut(records.mapInArrow(run, "key long, share double").groupBy("key").agg(F.max("share").alias("share")))
    while (hot := shares.where(F.col("share") * total > piece)).count() > MOST_HOT:
        piece *= 2
    rows = hot.select("key", F.ceil(F.col("share") * total / piece).cast("int").alias("pieces")).orderBy("key").collect()
    return np.array([r["key"] for r in rows], dtype=np.int64), np.array([r["pieces"] for r in rows], dtype=np.int64)


def sided(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The key with the side in its last two bits, so that one sort by one column puts bucket and side in order."""
    return (key & -4) | side


def mixed(key: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The key of a piece of a bucket."""
    with np.errstate(over="ignore"):
        x = (key.view(np.uint64) ^ (piece.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def bucketed(records: DataFrame, keys: Keys, hot: tuple[np.ndarray, np.ndarray], carried: list[str], planes: int = 1) -> DataFrame:
    """(key, id, f0, f1 and so on, carried): a row per record and key, with side 0, or 1 and 2 for the two sides of a hot
    piece.

    All keys of a record stand together, so that the shuffle's compression meets its id and fingerprint again at once.
    With many partitions they fall apart, and a row takes its full width.
    """
    kind = records.schema["id"].dataType.simpleString()
    parts = [f"f{k}" for k in range(2 * planes)]
    sent = records.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot_keys, pieces = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found, low = keys(part)
                draw = part.column("draw").to_numpy().view(np.uint64)
                n, per = found.shape
                key, row, side = found.ravel(), np.repeat(np.arange(n), per), np.zeros(n * per, dtype=np.int64)
                if len(hot_keys):
                    place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    is_hot = np.flatnonzero((hot_keys[place] == key) & (pieces[place] > 1))
                    many = pieces[place[is_hot]]
                    own = draw[row[is_hot]] % many.astype(np.uint64)
                    every = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    plain = np.setdiff1d(np.arange(len(key)), is_hot)
                    key, row, side = (
                        np.concatenate([key[plain], mixed(key[is_hot], own), mixed(np.repeat(key[is_hot], many), every)]),
                        np.concatenate([row[plain], row[is_hot], np.repeat(row[is_hot], many)]),
                        np.repeat(np.arange(3), [len(plain), len(is_hot), many.sum()]),
                    )
                at_row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(sided(key, side)), part.column("id").take(at_row), *[pa.array(low[row, k]) for k in range(2 * planes)], *[part.column(c).take(at_row) for c in carried]], ["key", "id", *parts, *carried])

    return records.withColumn("draw", F.xxhash64("id")).mapInArrow(run, f"key long, id {kind}" + "".join(f", {c} long" for c in [*parts, *carried]))


def self_pairs(records: DataFrame, keys: Keys, within: int, carried: tuple[str, ...] = (), piece: int | None = None, planes: int = 1, total: int | None = None) -> DataFrame:
    """(a, b) with a < b of all records (id, ...) that share a key and differ in at most ``within`` places of the
    fingerprint, a place being one bit of each of its ``planes``.

    With ``carried`` columns t and e (bit masks), only pairs come out where one's t meets the other's e. ``records`` is
    read three times, with ``total`` (their number) twice: it should be written.
    """
    kind = records.schema["id"].dataType.simpleString()
    total = max(records.count() if total is None else total, 1)
    hot = hot_buckets(records, keys, total, PIECE if piece is None else piece)
    rows = bucketed(records, keys, hot, list(carried), planes).repartition(F.shiftright("key", 2)).sortWithinPartitions("key")

    stored = ["key", "id", *[f"f{k}" for k in range(2 * planes)], *carried]
    compared = stored[2:]

    def met(left: dict, right: dict) -> np.ndarray:
        apart = 0
        for half in range(2):
            differ = left[f"f{half}"] ^ right[f"f{half}"]
            for k in range(2 + half, 2 * planes, 2):
                differ |= left[f"f{k}"] ^ right[f"f{k}"]
            apart = apart + np.bitwise_count(differ.view(np.uint64))
        ok = apart <= within
        if carried:
            ok &= ((left["t"] & right["e"]) != 0) | ((left["e"] & right["t"]) != 0)
        return ok

    def near(left: dict, i: np.ndarray, right: dict, j: np.ndarray):
        """Those of the pairs (i of left, j of right) that are near, as ids a < b."""
        out_a, out_b = [], []
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            ok = met({n: left[n][x] for n in compared}, {n: right[n][y] for n in compared})
            out_a.append(left["id"][x[ok]])
            out_b.append(right["id"][y[ok]])
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (left["id"][:0], right["id"][:0])

    def blocks(left: dict, right: dict, pick: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """As ``near``, of all pairs (of a run with itself: i < j) that ``pick`` takes by their places; none is listed before."""
        high, wide = BLOCK
        for x in range(0, len(left["id"]), high):
            down = {n: left[n][x : x + high, None] for n in compared}
            for y in range(x if left is right else 0, len(right["id"]), wide):
                i, j = np.nonzero(met(down, {n: right[n][None, y : y + wide] for n in compared}))
                if len(i):
                    i, j = i + x, j + y
                    ok = pick(i, j)
                    yield left["id"][i[ok]], right["id"][j[ok]]

    def batch_of(a, b):
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        table = pa.table({"a": a.tolist() if a.dtype == object else a, "b": b.tolist() if b.dtype == object else b})
        return table.group_by(["a", "b"]).aggregate([]).to_batches()

    def runs(rows: dict):
        """Pairs within runs of equal keys of side 0."""
        step, key = 0, rows["key"]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)[: len(key)]) + 1
        size = np.diff(ends, prepend=0)
        for end, n in zip(ends[size >= LONG], size[size >= LONG]):
            run = {c: rows[c][end - n : end] for c in stored}
            yield from blocks(run, run, np.less)
        i = np.flatnonzero(np.repeat(size < LONG, size))
        while len(i):
            step += 1
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if len(i):
                yield near(rows, i, rows, i + step)

    def run(batches):
        names = [*stored, "side"]
        waiting, left = None, None
        for batch in chained(batches):
            if batch is not None:
                rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in stored}
                rows |= {"key": rows["key"] >> 2, "side": rows["key"] & 3}
                if waiting is not None:
                    rows = {n: np.concatenate([waiting[n], rows[n]]) for n in names}
                whole = np.searchsorted(rows["key"], rows["key"][-1], "left")  # the last key may go on
                streams = rows["side"][-1] == 2
                ready, waiting = ({n: rows[n] for n in names}, None) if streams else ({n: rows[n][:whole] for n in names}, {n: rows[n][whole:] for n in names})
            else:
                ready, waiting = waiting, None
            if ready is None or not len(ready["key"]):
                continue
            plain = {n: ready[n][ready["side"] == 0] for n in names}
            found = list(runs(plain))
            cut_ = ready["side"] > 0
            if cut_.any():
                for key in np.unique(ready["key"][cut_]):
                    own, other = ({n: ready[n][(ready["key"] == key) & (ready["side"] == s)] for n in names} for s in (1, 2))
                    if len(own["key"]):
                        left = own if left is None or left["key"][0] != key else {n: np.concatenate([left[n], own[n]]) for n in names}
                    if left is None or left["key"][0] != key or not len(other["key"]):
                        continue
                    found += blocks(left, other, lambda i, j, own=left, other=other: own["id"][i] < other["id"][j])
            if found:
                a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                if len(a):
                    yield from batch_of(a, b)

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def chained(batches):
    """The batches that hold rows, and None after the last."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import outrank

NAN = float("nan")


def table(spark, rows):
    return spark.createDataFrame(rows, "g long, i long, a double, b double, c double, net_flow string, n string")



def scores():
    return {x: F.col(x) for x in "abc"}


def random_rows(seed, groups=6, most=30):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for i in range(int(r.integers(1, most))):
            v = [None if r.random() < 0.15 else NAN if r.random() < 0.1 else float(r.integers(0, 6)) * 10**k for k in range(3)]
            rows.append((g, i, *v, "", ""))
    return rows + rows[:5]


def value(x):
    return -np.inf if x is None or x != x else x


def items(rows):
    out = {}
    for g, i, *v in rows:
        out.setdefault(g, {})[i] = [value(x) for x in v[:3]]
    return out


def flows(group, q, p):
    n, out = len(group), {}
    pct = {}
    for s in range(3):
        for i, v in group.items():
            below = sum(w[s] < v[s] for w in group.values())
            same = sum(w[s] == v[s] for w in group.values())
            pct[i, s] = (below + (same - 1) / 2) / max(n - 1, 1)
    prefer = lambda d: float(d > 0) if p == 0 else min(max((d - q) / (p - q), 0), 1)
    for i in group:
        out[i] = sum(prefer(pct[i, s] - pct[j, s]) - prefer(pct[j, s] - pct[i, s]) for s in range(3) for j in group) / 3 / max(n - 1, 1)
    return out


@pytest.mark.parametrize("q, p, hot", [(0, 0, 50_000), (0.02, 0.25, 50_000), (0.1, 0.6, 4), (0, 0, 3)])
def test_against_all_pairs(spark, q, p, hot):
    rows = random_rows(7)
    got = {(r.g, r.i): (r.net_flow, r.position) for r in outrank.ranking(table(spark, rows).drop("net_flow"), "g", "i", scores(), indifference=q, preference=p, hot=hot).collect()}
    for g, group in items(rows).items():
        want = flows(group, q, p)
        assert {i: got[g, i][0] for i in group} == pytest.approx(want, abs=1e-6)
        order = sorted(group, key=lambda i: (-got[g, i][0], i))
        assert [got[g, i][1] for i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("seed, chunk, hot", [(1, 500, 50_000), (2, 3, 50_000), (3, 2, 4)])
def test_undefeated_against_all_pairs(spark, seed, chunk, hot):
    rows = random_rows(seed, 25, 9)
    got = {(r.g, r.i) for r in outrank.undefeated(table(spark, rows), "g", "i", scores(), chunk, hot).collect()}
    want = set()
    for g, group in items(rows).items():
        for i, v in group.items():
            if all((np.array(v) > np.array(w)).sum() > (np.array(v) < np.array(w)).sum() for j, w in group.items() if j != i):
                want.add((g, i))
    assert got == want


def test_range_does_not_dominate(spark):
    rows = [(1, 1, 1e9, 0.1, 0.1, "", ""), (1, 2, 1.0, 0.9, 0.9, "", ""), (1, 3, 0.5, 0.5, 0.5, "", "")]
    got = outrank.ranking(table(spark, rows), "g", "i", scores()).orderBy("position").first()
    assert got.i == 2


def test_empty_null_keys_and_bad_weights(spark):
    assert outrank.ranking(table(spark, []), "g", "i", scores()).count() == 0
    assert outrank.undefeated(table(spark, [(None, 1, 1.0, 1.0, 1.0, "", ""), (1, None, 1.0, 1.0, 1.0, "", "")]), "g", "i", scores()).count() == 0
    with pytest.raises(ValueError):
        outrank.ranking(table(spark, []), "g", "i", scores(), weights=[0, 0, 0])

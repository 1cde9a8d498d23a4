import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60))
def test_flight_keeps_both_totals(seed, n):
    r = np.random.default_rng(seed)
    size = r.integers(1, 9 if seed % 2 else 5_000, n)
    p = r.random(n) if seed % 3 else np.full(n, 0.37)
    out = mixing.flight(p.copy(), size, r)
    assert ((out >= 0) & (out <= 1)).all() and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and out @ size == pytest.approx(p @ size, rel=1e-5, abs=1e-2)
    landed = mixing.landing(out, size)
    assert set(landed) <= {0.0, 1.0}


def test_flight_keeps_probabilities_on_average():
    size = np.arange(1, 11)
    mean = np.mean([mixing.landing(mixing.flight(np.full(10, 0.3), size, np.random.default_rng(k)), size) for k in range(3_000)], axis=0)
    assert abs(mean.mean() - 0.3) < 0.02


def data(spark, n=600):
    r = np.random.default_rng(4)
    rows = [(k, ("page", "review", "note", None, "other")[0 if k < n // 2 else int(r.integers(0, 5))], int(r.integers(0, 90))) for k in range(n)]
    return spark.createDataFrame(rows, "id long, source string, n_tokens long"), rows


TARGETS = [("Page ", 0.4, 1), ("review", 0.35, 3), ("note", 0.2, 2), ("missing", 0.05, 9)]


@pytest.mark.parametrize("block", [20_000, 40])
def test_shares_are_reached_or_reported(spark, block):
    records, rows = data(spark)
    chosen, shares = mixing.mix(records, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), block=block)
    total = sum(t for _, _, t in rows)
    most = {"page": 1, "review": 3, "note": 2, "missing": 9}
    for s in shares.collect():
        own = sum(t for _, x, t in rows if x == s.source)
        want = s.target_share * total
        assert s.short == (own * most[s.source] < want)
        assert s.most_copies <= most[s.source]
        assert abs(s.mixed_tokens - min(want, own * most[s.source])) <= 90
    copies = chosen.collect()
    assert {r.source for r in copies} <= set(most) and min(r.copies for r in copies) >= 0 and all(r.n_tokens > 0 for r in copies)


def test_same_every_time(spark):
    records, _ = data(spark, 200)
    goal = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    a, b = (sorted(map(tuple, mixing.mix(records, goal)[0].collect())) for _ in range(2))
    assert a == b


def test_empty_and_null(spark):
    goal = spark.createDataFrame([*TARGETS, (None, 0.1, 1), ("review", 0.35, 3)], "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], "id long, source string, n_tokens long")
    chosen, shares = mixing.mix(none, goal)
    assert chosen.count() == 0 and {(r.source, r.mixed_tokens) for r in shares.collect()} == {("page", 0), ("review", 0), ("note", 0), ("missing", 0)}
    documents = spark.createDataFrame([(1, None, "page"), (2, "", "page"), (3, "a b", None), (3, "a b", None), (None, "x", "page")], "doc_id long, text string, source string")
    assert {(r.id, r.source, r.n_tokens) for r in mixing.sized(documents, "doc_id", "text", "source").collect()} == {(1, "page", 0), (2, "page", 0), (3, None, 2)}

import numpy as np
import pytest

from weftwork.llm import knn

KIND = "key long, vector array<float>, query string, vec string"


def table(spark, x, extra=()):
    rows = [(k, [float(v) for v in row], "q", "v") for k, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], KIND)


def clustered(n=300, dim=24, seed=0):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((n // 15, dim)) * 3
    return np.concatenate([c + 0.4 * r.standard_normal((15, dim)) for c in centers])


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    return {q: sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[q, j], j))[:k] for q in range(len(x))}


def found(df):
    out = {}
    for r in df.orderBy("query", "place").collect():
        out.setdefault(r["query"], []).append(r["id"])
    return out


def recall(got, want):
    return np.mean([len({*got.get(q, [])} & {*w}) / len(w) for q, w in want.items()])


def test_hashing_alone_finds_near_vectors(spark):
    x = clustered()
    got = found(knn.neighbours(table(spark, x), "key", "vector", 24, 10, exact=False))
    assert recall(got, brute(x, 10)) > 0.95


def test_hashing_alone_keeps_its_target_without_clusters(spark):
    x = np.random.default_rng(2).standard_normal((600, 24))
    report = knn.recall_report(table(spark, x), "key", "vector", 24).first()
    assert report.queries == report.vectors == 600 and report.settled_share > 0.9 and report.recall > 0.9


def test_with_the_exact_rest_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 50)
    monkeypatch.setattr(knn, "QUERIES", 30)
    x = np.concatenate([clustered(150), np.random.default_rng(5).standard_normal((100, 24))])
    got = found(knn.neighbours(table(spark, x), "key", "vector", 24, 10, first=4, most=8, target=0.99))
    assert recall(got, brute(x, 10)) > 0.97
    alone = found(knn.neighbours(table(spark, x), "key", "vector", 24, 10, first=4, most=8, target=0.99, exact=False))
    assert recall(alone, brute(x, 10)) < recall(got, brute(x, 10))


def test_the_latest_row_of_a_key_counts(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 0.1], 1), (3, [0.1, 1.0], 1), (4, [1.0, 0.0], 1), (4, None, 2)]
    df = spark.createDataFrame(rows, "key long, vector array<double>, at int")
    got = found(knn.neighbours(df, "key", "vector", 2, 1, order="at"))
    assert got[1] == [3] and 4 not in got


def test_a_bucket_with_a_third_of_all_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 20)
    r = np.random.default_rng(7)
    x = r.standard_normal((240, 24))
    x[:80] = x[0] + 1e-3 * r.standard_normal((80, 24))  # one bucket
    got = found(knn.neighbours(table(spark, x), "key", "vector", 24, 10))
    want = brute(x, 10)
    assert recall({q: got[q] for q in range(80)}, {q: want[q] for q in range(80)}) > 0.97


def test_a_third_of_copies(spark):
    x = clustered(150)
    x[:50] = x[3]
    asked = spark.createDataFrame([(3,), (7,), (120,), (9_999,), (None,)], "key long")
    got = found(knn.neighbours(table(spark, x), "key", "vector", 24, 10, asked))
    assert got[3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10] and got[7] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10] and set(got) == {3, 7, 120}
    assert got[120] == brute(x, 10)[120]


def test_unusable_vectors_and_repeated_rows(spark):
    nan = float("nan")
    odd = [(100, None, "", ""), (101, [0.0] * 3, "", ""), (102, [1.0], "", ""), (103, [nan, 1.0, 1.0], "", ""), (104, [None, 1.0, 1.0], "", ""), (None, [1.0] * 3, "", ""), (0, [1.0, 0.0, 0.0], "", "")]
    got = found(knn.neighbours(table(spark, [[1, 0, 0], [2, 0, 0], [0, 1, 0]], odd), "key", "vector", 3, 10))
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert knn.neighbours(table(spark, np.zeros((0, 3))), "key", "vector", 3, 10).count() == 0


def test_success_is_what_happens():
    r = np.random.default_rng(1)
    base = r.standard_normal((400, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = r.standard_normal((400, 16))
    near = base + 0.3 * step / np.linalg.norm(step, axis=1)[:, None]
    slots, places = knn.hashes_of(base.astype(np.float32), 2, 6, 1.0, 3)
    other = knn.own_keys(knn.hashes_of(near.astype(np.float32), 2, 6, 1.0, 3)[0], 16, 3)
    keys = knn.probe_keys(slots, places, 16, 20, 3)
    assert (keys[:, :, 0] == knn.own_keys(slots, 16, 3)).all() and len(np.unique(keys[0, 0])) == 20
    sure = knn.successes(places, np.full(400, 0.3), 1.0, 20).mean(axis=0)
    assert (np.diff(sure) >= 0).all()
    for probes in (1, 5, 20):
        met = (keys[:, :, :probes] == other[:, :, None]).any(axis=(1, 2))
        # the norm of a Gaussian projection varies around the distance
        assert abs(sure[probes - 1] - met.mean()) < 0.08


def test_normal_distribution():
    from math import erf

    z = np.linspace(-6, 6, 200)
    assert np.abs(knn.normal(z) - np.array([0.5 * (1 + erf(v / 2**0.5)) for v in z])).max() < 2e-7


def test_perturbations_come_in_order():
    sets = knn.perturbations(4, 12)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == 12
    assert len(knn.perturbations(3, 1_000)) == 27 == len(knn.perturbation_places(3, 1_000))  # there are no more


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError):
        knn.neighbours(table(spark, np.eye(3)), "key", "vector", 70_000)

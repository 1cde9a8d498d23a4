from collections import Counter

from weftwork.llm import components, splits


def records(spark, rows):
    return spark.createDataFrame(rows, "part string, id long, label string")


def edges(spark, rows):
    return spark.createDataFrame(rows, "record long, entity string")


def test_components_over_chains_and_hot_entities(spark):
    chain = [(k, f"e{k}") for k in range(40)] + [(k + 1, f"e{k}") for k in range(40)]
    hot = [(k, "hot") for k in range(100, 300)]
    rows = {r.record: r.component for r in components.propagate(edges(spark, [*chain, *chain[:5], *hot, (500, "own"), (None, "x"), (501, None)])).collect()}
    assert {rows[k] for k in range(41)} == {0} and {rows[k] for k in range(100, 300)} == {100} and rows[500] == 500 and None not in rows and 501 not in rows


def test_groups_stay_together_in_proportion(spark):
    rows = [("a", k, ("x", "y", None)[k % 3]) for k in range(3000)] + [("a", 5, "y")] + [("b", k, "x") for k in range(50)] + [(None, 1, "x"), ("a", None, "x")]
    link = [(k, f"g{k // 4}") for k in range(0, 800)] + [(k, "big") for k in range(800, 1000)]
    got = splits.assign(records(spark, rows), edges(spark, link)).collect()
    assert len(got) == 3050 and len({(r.part, r.id) for r in got}) == 3050
    by = {}
    for r in got:
        by.setdefault((r.part, r.component), set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    for label in ("x", "y", None):
        n = Counter(r.split for r in got if r.part == "a" and r.label == label)
        assert abs(n["train"] - 800) <= 12 and abs(n["validation"] - 100) <= 8 and abs(n["test"] - 100) <= 8
    n = Counter(r.split for r in got if r.part == "b")
    assert n["train"] >= 38


def test_a_third_in_one_group_goes_to_train(spark):
    got = splits.assign(records(spark, [("a", k, "x") for k in range(900)]), edges(spark, [(k, "hot") for k in range(300)])).collect()
    n = Counter(r.split for r in got)
    assert {r.split for r in got if r.id < 300} == {"train"} and n == {"train": 720, "validation": 90, "test": 90}


def test_same_every_time_and_empty(spark):
    args = records(spark, [("a", k, "x") for k in range(60)]), edges(spark, [(1, "e"), (2, "e")])
    assert sorted(map(str, splits.assign(*args).collect())) == sorted(map(str, splits.assign(*args).collect()))
    assert splits.assign(records(spark, []), edges(spark, [])).count() == 0


def test_leaks(spark):
    member = spark.createDataFrame([("1k", "train", 1), ("1k", "test", 2), ("1k", "train", 3), ("full", "train", 1), ("full", "train", 2), ("1k", "test", 4)], "part string, split string, id long")
    link = edges(spark, [(1, "a"), (2, "a"), (1, "b"), (3, "b"), (4, "c"), (9, "c")])
    assert [tuple(r) for r in splits.leaks(link, member).collect()] == [("1k", "a")]


def test_digest(spark):
    d = "0f" * 32
    df = spark.createDataFrame([(f" SHA256:{d.upper()} ",), ("none",), (None,), (d + "a",)], "x string")
    assert [r[0] for r in df.select(splits.digest("x")).collect()] == [d, None, None, None]


def test_hot_entities_and_components_are_cut(spark, monkeypatch):
    monkeypatch.setattr("weftwork.operators.skew.PIECE", 25)
    edges = [(k, "hot") for k in range(100)] + [(k, f"e{k // 2}") for k in range(100, 300)]
    df = spark.createDataFrame(edges, "record long, entity string")
    got = {r.record: r.component for r in components.propagate(df).collect()}
    assert got == {k: 0 for k in range(100)} | {k: k // 2 * 2 for k in range(100, 300)}
    records = spark.createDataFrame([("p", k, "a" if k % 2 else None) for k in range(300)], "part string, id long, label string")
    placed = splits.assign(records, df)
    assert placed.count() == 300 and splits.leaks(df, placed.select("part", "split", "id")).count() == 0

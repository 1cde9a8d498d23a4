import re
from collections import Counter

from weftwork.llm import terms


def table(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "id string, body string, term string")


def brute(rows):
    texts = {k: t for k, t in rows if k is not None and t and t.strip()}
    occurrences, records = Counter(), Counter()
    for t in texts.values():
        found = re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", t.lower())
        occurrences.update(found)
        records.update(set(found))
    n = len(texts)
    return {t: (c, records[t], "rare" if records[t] < 3 else "common" if records[t] > n / 4 else None) for t, c in occurrences.items()}


ROWS = [("a", "The men's bag, the BAG"), ("b", "the hat''s"), ("b", "the hat''s"), ("c", None), ("d", "  \t"), ("e", "---"), (None, "lost"), ("f", "the " * 3000), ("g", "the bag café"), *[(f"x{k}", f"word{k % 7} filler") for k in range(40)]]


def got(df):
    return {r.term: (r.occurrences, r.records, r.mark) for r in df.collect()}


def test_counts_and_marks(spark):
    assert got(terms.frequencies(table(spark, ROWS), "id", "body")) == brute(ROWS)


def test_split_partitions_give_the_same(spark):
    rows = [(str(k), " ".join(f"t{(k * 31 + j) % 997}" for j in range(30)) + " hot") for k in range(300)]
    assert got(terms.frequencies(table(spark, rows).repartition(6), "id", "body", leaf_rows=40, bits=2)) == brute(rows)


def test_empty(spark):
    assert terms.frequencies(table(spark, []), "id", "body").count() == 0
    assert terms.frequencies(table(spark, [("a", None), ("b", "?!")]), "id", "body").count() == 0


def test_spills_are_removed(spark):
    import glob

    from weftwork.storage import shared_dir

    spilled = lambda: set(glob.glob(shared_dir(spark).replace("file:", "") + "/terms-*"))
    before = spilled()
    terms.frequencies(table(spark, ROWS), "id", "body").count()
    assert spilled() == before

"""Every query of the core against its SQL on the smallest test data."""

import glob
import math
import os

import pytest

DATA = os.environ.get("WEFTWORK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

import __spark_entry__ as entry  # noqa: E402
from weftwork.plans import registry  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "product_id", "score", "chunk_id", "rank"] and rows.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if (sql := registry.oracle_sql().get(name)) is None:
        assert got
        return
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted([tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()], key=str)
    assert got == want


def test_ann_search_has_every_neighbour(spark):
    columns = ["query_id", "rank", "product_id", "score"]
    near, exact = (sorted(tuple(r) for r in registry.queries()[name](spark, DATA).select(columns).collect()) for name in ("ann_search", "exact_search"))
    assert near == exact

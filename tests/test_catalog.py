"""Every registered query against its SQL on the smallest tables, and the entry module's contract."""

import math
import os

import pytest

import __spark_entry__ as entry
from lodestar import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


def close(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-6)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    values = [tuple(r) for r in got.collect()]
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert close(rows(got.columns, values), rows(columns, want.fetchall()))
    else:
        assert values


def test_inverted_file_recall_on_the_registered_query(spark):
    exact = catalog.QUERIES["knn_cosine_distance"](spark, DIR)
    from lodestar.operators.index import recall

    assert recall(catalog.QUERIES["ivf_search"](spark, DIR), exact) >= 0.9


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())

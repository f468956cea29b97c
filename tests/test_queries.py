"""Each named query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tideweave.plans.oracles import ORACLES
from tideweave.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(r):
    return tuple((x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in r)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
    rows = sorted(map(tuple, got.collect()), key=key)
    want = sorted(want, key=key)
    assert len(rows) == len(want) > 0
    assert all(same(x, y) for r, w in zip(rows, want) for x, y in zip(r, w)), next((r, w) for r, w in zip(rows, want) if not all(map(same, r, w)))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


def test_registry(spark):
    from tideweave.plans.registry import NAMES, run

    assert set(NAMES.values()) <= set(QUERIES)
    assert run("MAP_LONG_MICRO_BENCHMARK", spark, SF).columns == ["auction", "euros"]
    with pytest.raises(ValueError):
        run("NO_SUCH_QUERY", spark, SF)


def test_matrices_count_all_rows(spark):
    """Also where A and B have more rows than any sample."""
    big = "/root/testdata/sf0.1"
    c = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{big}/{t}.parquet'")
    for name in ("join_match_matrix", "join_match_matrix_all"):
        got = sorted(map(tuple, QUERIES[name](spark, big).collect()))
        assert got == sorted(c.execute(f"select low, high, matches from ({ORACLES[name]})").fetchall())

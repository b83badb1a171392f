"""Every named query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tensorframe import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    want = sql.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    got, want = (x[order].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_extents(spark, sql):
    """Outer product, broadcast and self product leave no supplier and no part out."""
    run = lambda name: {tuple(r)[:2]: r.v for r in catalogue.QUERIES[name](spark, str(DATA)).collect()}
    r = {(i, j): v for i, j, v in sql.sql(f"SELECT i, j, v FROM {catalogue.R}").fetchall()}
    size, nation = (dict(sql.sql(f"SELECT * FROM {t}").fetchall()) for t in (catalogue.SIZE, catalogue.NATION))
    assert run("x_outer") == {(i, j): x * y for i, x in nation.items() for j, y in size.items()}
    want = {(i, j): y for i in range(max(nation) + 1) for j, y in size.items()}
    for at, v in r.items():
        want[at] = want.get(at, 0) + v
    assert run("x_add_bc") == want
    by, dot = {}, {}
    for (i, j), v in r.items():
        by.setdefault(j, []).append((i, v))
    for row in by.values():
        for i, x in row:
            for k, y in row:
                dot[i, k] = dot.get((i, k), 0) + x * y
    assert run("x_self_product") == dot and max(len(x) for x in by.values()) > 1

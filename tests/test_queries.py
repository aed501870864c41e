"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from wayfleet import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def shown(value):
    return "null" if value is None else f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    run = duck.execute(queries.oracle_sql()[name])
    order = [d[0] for d in run.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(shown(r[order.index(c)]) for c in columns) for r in run.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_others_run(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0

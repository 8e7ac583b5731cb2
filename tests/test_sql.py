"""Every query with SQL gives the rows that the SQL gives, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from terrachron.plans.queries import QUERIES, SQL

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(found, columns):
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, (r[c] for c in columns))) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, tables, name):
    df, sql = QUERIES[name](spark, str(SMALL)), tables.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got, want = rows(df.collect(), columns), rows([dict(zip(sql.columns, r)) for r in sql.fetchall()], columns)
    assert got == want


def test_queries_without_sql_are_few():
    assert set(QUERIES) == set(SQL)

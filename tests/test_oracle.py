"""Every registered query against DuckDB on the same tables."""

import duckdb
import pytest

from tests.conftest import DATA
from towerlens.plans.catalog import QUERIES
from towerlens.plans.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def expected(sf_dir, sql):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    sf_dir = f"{DATA}/sf0.01"
    got = QUERIES[name](spark, sf_dir)
    names, rows = expected(sf_dir, ORACLE[name])
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.collect(), got.columns) == canonical(rows, names)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)

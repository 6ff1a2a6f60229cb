"""Every query that has SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = rows(columns, cursor.fetchall())
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, map(tuple, df.collect()))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(g, w, strict=True)), (g, w)

"""Every registered query of the order jobs against its SQL in DuckDB, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from orderlens.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0 if math.isfinite(v) else str(v)
    return v


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(cursor.fetchall(), columns)

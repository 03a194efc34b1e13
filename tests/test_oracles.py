"""Queries against their SQL in another engine, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from tillgrain import queries

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = list(queries.ORACLES)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else float(f"{float(v):.10g}")
    return str(v) if isinstance(v, datetime.date) else v


def bag(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, folder, name):
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = bag(df.select(*columns).collect())
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == bag(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())

"""Every registered query runs on the smallest tables; those with SQL give what the SQL gives."""

import math
from pathlib import Path

import pytest

from ridgeline import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.8g}"
    return repr(value)


def key(row):
    return tuple(map(plain, row))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    if name not in SQL:
        return
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=key)
    assert len(rows) == len(want)
    for got, due in zip(rows, want, strict=True):
        assert all(map(same, got, due)), (got, due)

"""Every registered query next to its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from registry import all_oracle_sql, all_queries
from tests.conftest import SF
from tools.check_oracle import canonical, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(all_queries()))
def test_same_rows(spark, duck, name):
    df = all_queries()[name](spark, SF)
    got = canonical([plain(tuple(r)) for r in df.collect()], df.columns)
    sql = all_oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical([plain(r) for r in cursor.fetchall()], names)


def test_every_sql_has_a_query():
    assert set(all_oracle_sql()) <= set(all_queries())

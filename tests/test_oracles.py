"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest
from fixtures_path import DATA

from taperline.plans.registry import ORACLE_SQL, QUERIES

SF = str(DATA / "sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.8g}"
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    got = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted(tuple(shown(r[i]) for i in at) for r in got.fetchall())

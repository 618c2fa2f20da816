"""Every registered telemetry query against its SQL in DuckDB, and the shape of those without SQL."""

import os

import duckdb
import pandas as pd
import pytest

from vesselflow import queries as Q

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, db, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = db.execute(Q.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    assert len(a) > 0


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_without_sql(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0

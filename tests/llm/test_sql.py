"""The SQL given for text queries against the queries, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from vesselflow.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want) > 0

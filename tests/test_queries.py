"""Every registry query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cohort_spark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def cell(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(cell(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", ["a4_series_verdict", "io10_series_details"])
def test_share_of_an_exact_half_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()  # series 10: 9 of 16 images are tiny, 0.5625
    con.execute("CREATE TABLE events AS SELECT IF(i = 14, 16, i) AS event_id, 10::BIGINT AS user_id FROM range(16) r(i)")
    con.execute("CREATE TABLE customer AS SELECT 11::BIGINT AS c_custkey")
    for table in ("events", "customer"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    found, wanted = rows(QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(SQL[name]).df())
    assert found == wanted and any("9 of 16 rejected (0.562)" in str(r) for r in found)

"""Every named query against its SQL on the smallest test data."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tideframe.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 9))
    return str(v)


def rows(df, columns):
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_evolved_schema_read_keeps_odd_ids(spark, small, tmp_path):
    """Null and negative ids, ids beyond an int and null columns: every row, as in the SQL."""
    ids = ["event_id", "-event_id - 1", "null::bigint", "event_id + 3000000000", "-event_id - 3000000000"]
    parts = [f"select * replace ({x} as event_id) from '{small}/events.parquet' where event_id < 12" for x in ids]
    parts.append(f"select event_id + 100 as event_id, ts, null::bigint, null::varchar, null::double, null::varchar from '{small}/events.parquet' where event_id < 12")
    c = duckdb.connect()
    c.sql(f"copy ({' union all '.join(parts)}) to '{tmp_path}/events.parquet'")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.sql(ORACLES["evolved_schema_read"]).fetchall()
    got = [tuple(r) for r in QUERIES["evolved_schema_read"](spark, str(tmp_path)).select("event_id", "id", "amount", "state", "legacy_s3", "legacy").collect()]
    assert len(got) == 72 and sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_estimates(spark, small):
    n = {r.field: r.ndv for r in QUERIES["ndv_theta"](spark, small).collect()}
    assert n["event_type"] == 5 and abs(n["event_id"] - 1000) < 60
    assert QUERIES["tier_flushes"](spark, small).count() >= 0

"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    r = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda x: tuple((y is None, str(y)) for y in x)
    a = sorted((tuple(norm(x[c]) for c in sorted(cols)) for x in got), key=key)
    b = sorted((tuple(norm(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=key)
    assert a == b

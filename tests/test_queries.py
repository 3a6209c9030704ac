"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
MODULES = ("auditlake.plans.readmodels", "auditlake.plans.roundtrips", "auditlake.plans.submissions")


def shown(v):
    if v is None:
        return "-"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def names():
    import importlib

    return [k for m in MODULES for k in getattr(importlib.import_module(m), "ORACLE")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    assert got == sorted(tuple(shown(x[have.index(c)]) for c in cols) for x in r.fetchall())

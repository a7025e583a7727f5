"""The registered queries against their SQL on the smallest data, and plan checks."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(rows):
    v = lambda x: repr(round(float(x), 6)) if isinstance(x, float) or type(x).__name__ == "Decimal" else x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else x
    return sorted((tuple(v(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in res.fetchall()]
    assert norm(got) == norm(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_plans_push_down(spark):
    plan = entry.queries()["flt01_scope"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(class_name,manuals)" in plan
    plan = entry.queries()["agg01_chunks_per_base"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<kb_id:string>" in plan


def test_entry_smoke(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).columns

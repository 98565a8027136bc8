import glob
import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pointloom.plans import registry

DATA = "/root/testdata/sf0.001"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.7g}") + 0.0
        return float(v) if type(v).__name__ == "Decimal" else v

    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    con.execute(registry.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in con.description)
    want = rows_of([d[0] for d in con.description], con.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["kind", "point_id", "other_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_llm():
    code = "import sys, __spark_entry__, pointloom.plans.registry, pointloom.streaming.ingest, pointloom.sources.tiled; print([m for m in sys.modules if m.startswith('pointloom.llm')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert out.stdout.strip() in ("[]", "['pointloom.llm']"), out.stderr

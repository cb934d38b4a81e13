"""Registered queries against their SQL on the smallest given tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import gitdata  # noqa: F401  adds its queries
from tidemark.plans.testdata import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def compare(spark, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = query(spark, DATA)
    columns = sorted(frame.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect()) == want


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
@pytest.mark.parametrize(("name", "reads"), [("hotspots_top", 1), ("owners_top", 1), ("age_top", 1), ("tally", 1), ("summary", 2), ("coupling_top", 2)])
def test_final_plans_read_the_events_once_or_twice(spark, name, reads):
    """What is planned several times is one exchange in the end; the second reading, of commit keys alone, finds the broad commits."""
    frame = QUERIES[name](spark, DATA)
    frame.collect()
    final = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and final.count("FileScan parquet [l_") <= reads
    assert "CartesianProduct" not in final

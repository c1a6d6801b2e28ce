"""Every query with SQL against DuckDB, values as they are; the others give rows."""

import glob
import os

import duckdb
import pytest

from ranklode.plans import QUERIES, SQL

#: The tables; with RANKLODE_SF=/root/testdata/sf0.01 none but these queries may give nothing.
SF = os.environ.get("RANKLODE_SF", "/root/testdata/sf0.001")
EMPTY = {"k1_empty_documents"}


def same(v):
    """A value as text: floats with all digits and the sign of zero."""
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(same, v)) + "]"
    if v is None or v != v:
        return "NULL"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    got = df.collect()
    assert got or name in EMPTY or not SF.endswith("sf0.01")
    assert sorted(tuple(same(r[c]) for c in sorted(df.columns)) for r in got) == sorted(tuple(same(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_common_subsequence_of_whole_documents(spark):
    words = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.lcs for r in QUERIES["f13_common_subsequence"](spark, SF).collect()}
    assert set(got) == {k for k in words if k + 1 in words}
    some = [k for k in got if len(words[k]) * len(words[k + 1]) < 100_000]
    assert len(some) > 20 and max(got.values()) > 40
    for k in some:
        best = [0] * (len(words[k + 1]) + 1)
        for x in words[k]:
            last = best[:]
            for j, y in enumerate(words[k + 1]):
                best[j + 1] = last[j] + 1 if x == y else max(last[j + 1], best[j])
        assert got[k] == best[-1]

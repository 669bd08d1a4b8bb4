"""Every registered query of the library against its SQL, on the smallest tables; and the plans that matter."""

import math
import os

import pytest

from epochsql import catalog_queries as Q
from epochsql.engine import Session

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    for t in Q.TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return duckdb


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_sql(spark, oracle, name):
    df = Q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = oracle.sql(Q.ORACLES[name])
    names = list(r.columns)
    want = sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall())
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DIR).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    s = Session(spark)
    s.register_parquet("orders", f"{DIR}/orders.parquet")
    p = plan(s.sql("SELECT o_orderkey FROM orders WHERE o_totalprice = 5.5 AND o_orderstatus = 'F';"))
    assert "GreaterThanOrEqual(o_totalprice" in p and "EqualTo(o_orderstatus,F)" in p
    assert "o_orderpriority" not in p[p.rindex("ReadSchema") :]


def test_top_k_does_not_sort_everything(spark):
    s = Session(spark)
    s.register_parquet("orders", f"{DIR}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(s.sql("SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 5;"))


def test_equi_joins_are_no_nested_loops(spark):
    s = Session(spark)
    for t in ("orders", "customer"):
        s.register_parquet(t, f"{DIR}/{t}.parquet")
    p = plan(s.sql("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey;"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_as_of_reads_no_later_files(spark, tmp_path):
    s = Session(spark, str(tmp_path / "store"))
    s.execute("CREATE TABLE t (a INT);")
    for i in range(3):
        s.execute(f"INSERT INTO t VALUES ({i});")
    first = s.db.commits()[1]["ts"]
    df = s.db.as_of("t", first, "forward")
    assert len(df.inputFiles()) == 1 and df.count() == 1


def test_forward_replay_filters_the_scan_and_moves_rows_once(spark):
    for name in ("as_of_forward", "as_of_future"):
        p = plan(Q.QUERIES[name](spark, DIR))
        p = p[p.index("== Physical Plan ==") :]
        assert "LessThanOrEqual(ts" in p and p.count("Exchange") == 1

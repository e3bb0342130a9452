"""Every query against its SQL, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def shape(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x != x:
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(plain(None if str(x) in ("<NA>", "NaT") else x) for x in row) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got) == shape(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_results_do_not_depend_on_partitions(spark):
    names = ["structural_links", "task_states", "recall_search", "wal_window_text"]
    before = {n: shape(entry.queries()[n](spark, SMALL).toPandas()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert before == {n: shape(entry.queries()[n](spark, SMALL).toPandas()) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plans_are_the_ones_wanted(spark):
    def plan(name):
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().toString()

    assert "PushedFilters: [" in plan("ledger_read_since") and "GreaterThanOrEqual(o_orderdate" in plan("ledger_read_since")
    for name in ("semantic_links", "wal_window_text", "invalidated_in_window", "structural_links", "diary_anchors", "touch_tier"):
        joins = plan(name).count("NestedLoop") if name != "touch_tier" else 0  # touch_tier joins tables of one row
        assert "CartesianProduct" not in plan(name) and not joins


def test_detect_takes_every_order_as_a_commit(spark, duck):
    got = entry.queries()["detect"](spark, SMALL).where("how = 'created'").count()
    assert got == duck.execute("select count(*) from lineitem join orders on l_orderkey = o_orderkey").fetchall()[0][0]

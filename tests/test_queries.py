"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check_oracle import TABLES, rows_of

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.collect()
    if name in ORACLE:
        result = con.execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    spark.read.parquet(f"{sf}/lineitem.parquet")
    from pyspark.sql import functions as F

    from voxloom.bindings import table
    from voxloom.operators.masking import box_slice
    stored = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("z"), F.col("c_nationkey").alias("y"), F.col("c_nationkey").alias("x"), "c_acctbal")
    plan = box_slice(stored, (2, 2, 2), (9, 9, 9))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey), GreaterThanOrEqual(c_nationkey,2)" in plan
    assert "c_mktsegment" not in plan

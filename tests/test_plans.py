"""Plan-shape checks: no cartesian or nested-loop joins anywhere, pruning and pushdown reach the
scans, and no limits or single-task steps over tables."""

import pytest

import __spark_entry__ as E

QUERIES = E.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, sf_dir, key):
    """Nor does a query cut a table to a number of rows, or squeeze one into a single task."""
    plan = _plan(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan and "Coalesce 1" not in plan


def test_flagship_prunes_columns(spark, sf_dir):
    plan = _plan(QUERIES["dept_salary"](spark, sf_dir))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_parquet_scan_pushes_filter(spark, sf_dir):
    plan = _plan(QUERIES["parquet_scan"](spark, sf_dir))
    assert "GreaterThanOrEqual(employee_id,100)" in plan
    assert "ReadSchema: struct<employee_id:bigint,email:string,salary:string>" in plan


def test_unbound_users_stay_in_the_jvm(spark, sf_dir):
    """The rate limiter hands Python only the runs that can reach a limit."""
    from quarry.operators import metrics
    from quarry.plans import fixtures as fx
    runs = metrics.admission_runs(fx.table(spark, sf_dir, "requests").selectExpr(
        "user_id", "unix_micros(cast(ts as timestamp)) div 60000000 as b", "100 as lim"))
    assert runs.filter("binds").count() == 0 and runs.count() > 0

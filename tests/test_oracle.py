"""Every registered query against its DuckDB oracle on the smallest tables (the driver runs
the same comparison at sf0.01); queries without an oracle must at least run."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, key):
    df = QUERIES[key](spark, sf_dir)
    if key in ORACLES:
        problems, _ = compare(df, con, ORACLES[key])
        assert not problems, problems
    else:
        assert df.count() >= 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"department", "avg_salary", "headcount", "avg_performance"}
    assert df.count() > 0


def test_entry_imports_without_a_session():
    """The driver reads the queries before it starts Spark."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(E.__file__)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

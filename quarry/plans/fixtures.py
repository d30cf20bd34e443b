"""Bindings of the driver's tables onto the inputs the operators expect (FIXTURES.md §2).

Each view is one SQL body written in the dialect Spark SQL 4.1 and DuckDB share, so the
same text is registered as a Spark temp view and inlined as a CTE in the DuckDB oracle.
The views only rename and derive columns row by row (plus small fixed dimension
crossings); every operator still runs over the whole base table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir, ship_package
from quarry.sources.readers import path_exists

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

AS_OF = "2024-06-30"

VIEWS: dict[str, str] = {}

VIEWS["employees_raw"] = """SELECT
  c_custkey AS employee_id,
  concat('  ', upper(split_part(c_name, '#', 1)), ' ') AS first_name,
  concat('n', split_part(c_name, '#', 2)) AS last_name,
  CASE WHEN c_custkey % 53 = 0 THEN 'no-at-sign' WHEN c_custkey % 59 = 0 THEN NULL
       ELSE concat(' C', CAST(c_custkey AS string), '@Company.COM ') END AS email,
  concat(' ', CASE c_custkey % 7 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Finance' WHEN 2 THEN 'HR'
       WHEN 3 THEN 'Marketing' WHEN 4 THEN 'Sales' WHEN 5 THEN 'Operations' ELSE 'Legal' END, ' ') AS department,
  CASE WHEN c_custkey % 61 = 0 THEN 'N/A' WHEN c_custkey % 67 = 0 THEN ''
       ELSE CAST(c_acctbal AS string) END AS salary,
  CASE WHEN c_custkey % 73 = 0 THEN NULL ELSE CAST(c_custkey % 60 AS double) / 10 END AS performance_rating,
  CASE WHEN c_custkey % 71 = 0 THEN 'not-a-date'
       ELSE CAST(date '2010-01-01' + CAST(c_custkey * 41 % 6000 AS int) AS string) END AS hire_date,
  CASE c_custkey % 5 WHEN 3 THEN 'On_Leave' WHEN 4 THEN 'terminated ' ELSE ' Active' END AS status,
  date '1950-01-01' + CAST(c_custkey * 37 % 18000 AS int) AS birth_date
FROM customer"""

VIEWS["departments"] = """SELECT
  CAST(n_nationkey AS bigint) AS department_id, n_name AS department_name,
  CAST(n_nationkey * 4 AS bigint) AS manager_id,
  CAST(100000 * (n_regionkey + 1) AS double) AS budget
FROM nation"""

VIEWS["expenses_raw"] = """SELECT
  o_orderkey AS expense_id,
  CASE WHEN o_orderkey % 83 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS employee_id,
  CAST(o_custkey % 25 AS bigint) AS department_id,
  concat(' ', upper(o_orderpriority)) AS category,
  CASE WHEN o_orderkey % 41 = 0 THEN concat('-', CAST(o_totalprice AS string))
       ELSE CAST(o_totalprice AS string) END AS amount,
  CAST(CAST(o_orderdate AS date) AS string) AS expense_date,
  CASE o_orderstatus WHEN 'F' THEN 'Approved ' WHEN 'O' THEN 'Pending' ELSE 'Rejected' END AS status
FROM orders"""

VIEWS["budgets_raw"] = """SELECT
  s_suppkey * 4 + q AS budget_id, CAST(s_nationkey AS bigint) AS department_id,
  concat(' ', n_name) AS department, 2024 AS fiscal_year, q AS quarter,
  CASE WHEN s_suppkey % 10 = 0 THEN CAST(0 AS double) ELSE abs(s_acctbal) + 1000 END AS budget_amount,
  abs(s_acctbal) * 0.8 AS allocated_amount, abs(s_acctbal) * 0.5 AS spent_amount
FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES (1), (2), (3), (4)) t(q)"""

VIEWS["performance_reviews_raw"] = """SELECT
  l_orderkey * 10 + l_linenumber AS review_id, l_suppkey AS employee_id,
  l_partkey % 100 AS reviewer_id,
  CAST(CAST(l_shipdate AS date) AS string) AS review_date,
  CAST(l_quantity / 8 AS double) AS rating,
  CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'N' THEN 'false' ELSE NULL END AS goals_met
FROM lineitem"""

VIEWS["revenue"] = """SELECT
  l_returnflag AS stream, l_extendedprice * (1 - l_discount) AS amount,
  CAST(l_shipdate AS date) AS revenue_date
FROM lineitem"""

VIEWS["requests"] = """SELECT
  event_id AS request_id, ts, user_id,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value / 100 AS duration_s,
  CASE user_id % 4 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'user' WHEN 2 THEN 'premium' ELSE 'admin' END AS role
FROM events"""

VIEWS["user_queries"] = """SELECT
  conv_id * 1000 + turn AS query_id, conv_id, turn, text AS query
FROM conversations WHERE role = 'user'"""

VIEWS["budget_allocations"] = """SELECT
  ps.s_suppkey * 100 + q * 10 + c AS allocation_id, ps.s_suppkey * 4 + q AS budget_id,
  concat('category_', CAST(c AS string)) AS category,
  abs(s_acctbal) * 0.3 AS allocated_amount, abs(s_acctbal) * 0.2 AS spent_amount
FROM supplier ps CROSS JOIN (VALUES (1), (2), (3)) a(q) CROSS JOIN (VALUES (1), (2)) b(c)"""

VIEWS["contacts"] = """SELECT
  c_custkey AS contact_id,
  CASE c_custkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'VN' ELSE 'DE' END AS country,
  concat('+', CAST(c_custkey % 90 AS string), ' (', CAST(200 + c_custkey % 700 AS string), ') 555-',
         CAST(1000 + c_custkey % 9000 AS string)) AS phone,
  CASE WHEN c_custkey % 10 = 0 THEN 'broken@' ELSE concat('u', CAST(c_custkey AS string), '@company.com') END AS email,
  CASE c_custkey % 9 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '03/05/2024' WHEN 2 THEN 'March 5, 2024' WHEN 3 THEN '25/12/2024'
       WHEN 4 THEN '2024-03-05 10:20:30' WHEN 5 THEN '03/05/2024 10:20:30' WHEN 6 THEN '5 March 2024' WHEN 7 THEN NULL ELSE 'soon' END AS joined
FROM customer"""

VIEWS["query_log"] = """SELECT
  event_id AS query_id, ts, concat('agent_', event_type) AS agent,
  concat('model_', CAST(user_id % 2 AS string)) AS model,
  value / 100 AS processing_time, CAST(event_id % 101 AS double) / 100 AS confidence
FROM events"""

# A ten-row US holiday list used by the business-calendar jobs (the
# reference reads a country holiday package that is not available here).
HOLIDAYS = [
    ("1995-01-02", "New Year's Day"), ("1995-07-04", "Independence Day"),
    ("1995-12-25", "Christmas Day"), ("1996-01-01", "New Year's Day"),
    ("1996-07-04", "Independence Day"), ("1996-12-25", "Christmas Day"),
    ("1997-01-01", "New Year's Day"), ("1997-07-04", "Independence Day"),
    ("1997-12-25", "Christmas Day"), ("1998-01-01", "New Year's Day"),
]
VIEWS["holidays"] = "SELECT CAST(d AS date) AS holiday, name FROM (VALUES " + ", ".join(
    f"('{d}', '{n.replace(chr(39), chr(39) * 2)}')" for d, n in HOLIDAYS) + ") h(d, name)"

# Spark-side text of the two views that cross rows with a fixed list of quarters /
# categories: a generator (explode) replaces the constant cross join, same rows.
SPARK_VIEWS = dict(VIEWS)
SPARK_VIEWS["budgets_raw"] = VIEWS["budgets_raw"].replace(
    "CROSS JOIN (VALUES (1), (2), (3), (4)) t(q)", "LATERAL VIEW explode(array(1, 2, 3, 4)) t AS q")
SPARK_VIEWS["budget_allocations"] = VIEWS["budget_allocations"].replace(
    "CROSS JOIN (VALUES (1), (2), (3)) a(q) CROSS JOIN (VALUES (1), (2)) b(c)",
    "LATERAL VIEW explode(array(1, 2, 3)) a AS q LATERAL VIEW explode(array(1, 2)) b AS c")

_REGISTERED: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the base parquet tables of ``sf_dir`` and every fixture view as temp views."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # results depend on the session clock zone (windows, date casts): pin it to UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = id(spark)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("employees_raw"):
        return
    _REGISTERED[key] = sf_dir
    for t in BASE_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if path_exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(t)
    for name, body in SPARK_VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {body}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table read straight from parquet (scan with pruning and pushdown)."""
    if name in BASE_TABLES:
        register(spark, sf_dir)
        return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    register(spark, sf_dir)
    return spark.table(name)


def cte(*names: str) -> str:
    """``WITH`` prefix inlining the named views for the DuckDB oracle."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""

"""Data-quality bindings: G1-G12 over the cleaned curated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cleaning as cl
from quarry.operators import quality as dq
from quarry.operators import summaries as sm
from quarry.plans import fixtures as fx
from quarry.plans.bind_finance import EXP_CLEAN_SQL, REVIEWS_SQL, expenses_clean
from quarry.plans.bind_hr import CLEAN_SQL, clean_employees_df, employees_with_tenure
from quarry.plans.catalog import query

STRICT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
LOOSE = r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"


def _v(name, col, ordn, evaluated, unexpected, table="employees"):
    return (f"SELECT '{table}' AS table_name, '{name}' AS expectation, '{col}' AS column_name, "
            f"{ordn} AS ord, CAST({evaluated} AS BIGINT) AS evaluated, CAST({unexpected} AS BIGINT) AS unexpected")


def _unique_sql(col, src):
    return (f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}))",
            f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}) WHERE n > 1)")


def _suite_sql():
    u_ev, u_bad = _unique_sql("employee_id", "clean")
    rows = [
        _v("expect_column_to_exist", "employee_id", 0, 1, 0),
        _v("expect_column_values_to_not_be_null", "employee_id", 1, "(SELECT count(*) FROM clean)",
           "(SELECT count_if(employee_id IS NULL) FROM clean)"),
        _v("expect_column_values_to_be_unique", "employee_id", 2, u_ev, u_bad),
        _v("expect_column_to_exist", "first_name", 3, 1, 0),
        _v("expect_column_to_exist", "last_name", 4, 1, 0),
        _v("expect_column_values_to_not_be_null", "first_name", 5, "(SELECT count(*) FROM clean)",
           "(SELECT count_if(first_name IS NULL) FROM clean)"),
        _v("expect_column_values_to_not_be_null", "last_name", 6, "(SELECT count(*) FROM clean)",
           "(SELECT count_if(last_name IS NULL) FROM clean)"),
        _v("expect_column_to_exist", "email", 7, 1, 0),
        _v("expect_column_values_to_match_regex", "email", 8, "(SELECT count(email) FROM clean)",
           f"(SELECT count_if(email IS NOT NULL AND NOT regexp_matches(email, '{STRICT}')) FROM clean)"),
        _v("expect_column_to_exist", "salary", 9, 1, 0),
        _v("expect_column_values_to_be_between", "salary", 10, "(SELECT count(salary) FROM clean)",
           "(SELECT count_if(salary IS NOT NULL AND NOT salary BETWEEN 0 AND 1000000) FROM clean)"),
        _v("expect_column_values_to_be_between", "performance_rating", 11,
           "(SELECT count(performance_rating) FROM clean)",
           "(SELECT count_if(performance_rating IS NOT NULL AND NOT performance_rating BETWEEN 0.0 AND 5.0) FROM clean)"),
        _v("expect_column_values_to_be_in_set", "department", 12, "(SELECT count(department) FROM clean)",
           "(SELECT count_if(department IS NOT NULL AND department NOT IN ('engineering', 'finance', 'hr', "
           "'marketing', 'sales', 'operations')) FROM clean)"),
        _v("expect_column_values_to_be_in_set", "status", 13, "(SELECT count(status) FROM clean)",
           "(SELECT count_if(status IS NOT NULL AND status NOT IN ('active', 'inactive', 'terminated', "
           "'on_leave')) FROM clean)"),
    ]
    return CLEAN_SQL + "SELECT *, unexpected = 0 AS success FROM (\n" + "\nUNION ALL ".join(rows) + ")"


@query("dq_suite", _suite_sql())
def q_dq_suite(spark, sf):
    return dq.run_suite(clean_employees_df(spark, sf), dq.HR_SUITE, "employees")


@query("dq_unique", """SELECT 'documents' AS table_name, 'text' AS column_name,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS duplicate_rows,
  CAST(count_if(n > 1) AS BIGINT) AS duplicated_values
FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def q_dq_unique(spark, sf):
    return dq.duplicate_report(fx.table(spark, sf, "documents"), "text", "documents")


@query("schema_check", """SELECT * FROM (VALUES
  ('error', 'columns not found: last_name'),
  ('warning', 'salary is string, not double or bigint'),
  ('warning', 'performance_rating is string, not double')) t(level, message)
WHERE (SELECT count(*) FROM customer) >= 0""")
def q_schema_check(spark, sf):
    """Raw employees without a required column and with a rating read as text."""
    raw = fx.table(spark, sf, "employees_raw").drop("last_name").withColumn("performance_rating", F.col("performance_rating").cast("string"))
    return dq.schema_check(raw)


@query("dq_summary", _suite_sql().replace("SELECT *, unexpected = 0 AS success FROM (", ", suite AS (SELECT *, unexpected = 0 AS success FROM (", 1).replace(
    "\n, suite", ", suite", 1) + f""")
SELECT table_name, bool_and(success) AS success,
  list(expectation ORDER BY ord) FILTER (NOT success) AS failed_expectations, TIMESTAMP '{fx.AS_OF} 00:00:00' AS timestamp
FROM suite GROUP BY table_name""")
def q_dq_summary(spark, sf):
    return dq.suite_summary(dq.run_suite(clean_employees_df(spark, sf), dq.HR_SUITE, "employees"), f"{fx.AS_OF} 00:00:00")


@query("business_rules", CLEAN_SQL + f"""SELECT * FROM (
  SELECT 'non_positive_salary' AS rule, 'error' AS level, CAST(count_if(salary <= 0) AS BIGINT) AS violations FROM clean
  UNION ALL SELECT 'invalid_rating', 'error',
    CAST(count_if(performance_rating < 1.0 OR performance_rating > 5.0) AS BIGINT) FROM clean
  UNION ALL SELECT 'invalid_email', 'error', CAST(count_if(NOT regexp_matches(email, '{STRICT}')) AS BIGINT) FROM clean
  UNION ALL SELECT 'future_hire', 'warning', CAST(count_if(hire_date > DATE '{fx.AS_OF}') AS BIGINT) FROM clean)""")
def q_business_rules(spark, sf):
    return dq.business_rules(clean_employees_df(spark, sf), fx.AS_OF)


def gate_results(spark, sf):
    emps = clean_employees_df(spark, sf)
    revs = cl.clean_reviews(fx.table(spark, sf, "performance_reviews_raw"))
    summ = sm.department_summary(employees_with_tenure(spark, sf))
    tables = {"transformed_employees": emps, "transformed_performance_reviews": revs,
              "department_summary": summ}
    parts = []
    for name, suite in dq.GATE_SUITES.items():
        if suite:
            parts.append(dq.run_suite(tables[name], suite, name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("dq_gate", CLEAN_SQL[:-1] + ",\n" + REVIEWS_SQL + f"""SELECT table_name, failed_checks,
  CASE WHEN failed_checks > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM (
  SELECT 'transformed_employees' AS table_name,
    CAST((SELECT count_if(employee_id IS NULL) FROM clean) > 0 AS INTEGER)
    + CAST((SELECT count(*) FROM (SELECT employee_id FROM clean WHERE employee_id IS NOT NULL
            GROUP BY employee_id HAVING count(*) > 1)) > 0 AS INTEGER)
    + CAST((SELECT count_if(email IS NOT NULL AND NOT regexp_matches(email, '{LOOSE}')) FROM clean) > 0 AS INTEGER)
    + CAST((SELECT count_if(salary IS NOT NULL AND NOT salary BETWEEN 0 AND 1000000) FROM clean) > 0 AS INTEGER)
    AS failed_checks
  UNION ALL SELECT 'transformed_performance_reviews',
    CAST((SELECT count_if(rating IS NOT NULL AND NOT rating BETWEEN 1.0 AND 5.0) FROM reviews) > 0 AS INTEGER)
  UNION ALL SELECT 'department_summary', 0)""")
def q_dq_gate(spark, sf):
    return dq.gate(gate_results(spark, sf), list(dq.GATE_SUITES)).selectExpr("table_name", "CAST(failed_checks AS INT) AS failed_checks",
                                                       "status")


# The constraints of the warehouse tables: keys, references, required values and lengths.
WAREHOUSE = {
    "employees": ("emp_std", "employee_id", ["first_name", "last_name", "email"],
                  {"first_name": 100, "last_name": 100, "email": 255, "department": 100, "status": 20}, {}),
    "departments": ("departments", "department_id", ["department_name"], {"department_name": 100}, {"manager_id": "employees.employee_id"}),
    "expenses": ("exp_clean", "expense_id", [], {"category": 100, "status": 20},
                 {"employee_id": "employees.employee_id", "department_id": "departments.department_id"}),
    "documents": ("doc_files", "document_id", [], {"filename": 255, "document_type": 100}, {}),
    "performance_reviews": ("reviews", "review_id", [], {"review_period": 20},
                            {"employee_id": "employees.employee_id", "reviewer_id": "employees.employee_id"}),
    "budgets": ("budgets_raw", "budget_id", [], {}, {"department_id": "departments.department_id"}),
    "budget_allocations": ("budget_allocations", "allocation_id", [], {"category": 100}, {"budget_id": "budgets.budget_id"}),
}
DOC_FILES = ("SELECT doc_id AS document_id, concat('doc_', CAST(doc_id AS string), '.txt') AS filename, "
             "CASE WHEN doc_id % 50 = 7 THEN repeat('t', 101) ELSE source END AS document_type FROM documents")
REVIEW_PERIOD = "CASE WHEN review_id % 40 = 3 THEN 'a review period of many words' ELSE concat(CAST(year(review_date) AS string), '-Q') END"


def _constraints() -> list[tuple]:
    out = []
    for table, (_, key, required, lengths, refs) in WAREHOUSE.items():
        out.append((f"{table}_pk", "pk", table, key, None))
        if table == "employees":
            out.append(("employees_email_unique", "unique", table, "email", None))
        out += [(f"{table}_{c}_not_null", "not_null", table, c, None) for c in required]
        out += [(f"{table}_{c}_length", "max_length", table, c, n) for c, n in lengths.items()]
        out += [(f"{table}_{c}_fk", "fk", table, c, ref) for c, ref in refs.items()]
    return out


def _constraint_sql() -> str:
    views = CLEAN_SQL[:-1] + ",\n" + EXP_CLEAN_SQL[5:-1] + ",\n" + REVIEWS_SQL.replace("reviews AS (", "reviews_0 AS (") + ",\n" + fx.cte(
        "departments", "budgets_raw", "budget_allocations")[5:-1]
    views += f",\nreviews AS (SELECT *, {REVIEW_PERIOD} AS review_period FROM reviews_0),\ndoc_files AS ({DOC_FILES})\n"
    rows = []
    for name, kind, table, column, arg in _constraints():
        src = WAREHOUSE[table][0]
        dup = f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {src} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE n > 1)"
        bad = {"pk": f"{dup} + (SELECT count_if({column} IS NULL) FROM {src})", "unique": dup,
               "not_null": f"(SELECT count_if({column} IS NULL) FROM {src})",
               "max_length": f"(SELECT count_if(length({column}) > {arg}) FROM {src})"}.get(kind)
        if kind == "fk":
            parent, key = arg.split(".")
            bad = (f"(SELECT count(*) FROM {src} x WHERE x.{column} IS NOT NULL AND NOT EXISTS "
                   f"(SELECT 1 FROM {WAREHOUSE[parent][0]} p WHERE p.{key} = x.{column}))")
        rows.append(f"SELECT '{name}' AS constraint_name, '{kind}' AS kind, '{table}' AS table_name, '{column}' AS column_name, "
                    f"CAST({bad} AS BIGINT) AS violations")
    return views + "SELECT *, violations = 0 AS satisfied FROM (" + "\nUNION ALL ".join(rows) + ")"


@query("constraint_check", _constraint_sql())
def q_constraints(spark, sf):
    fx.register(spark, sf)
    tables = {"employees": fx.table(spark, sf, "employees_raw").withColumns(cl.employee_columns()),
              "departments": fx.table(spark, sf, "departments"), "expenses": expenses_clean(spark, sf),
              "documents": spark.sql(DOC_FILES), "budgets": fx.table(spark, sf, "budgets_raw"),
              "performance_reviews": cl.clean_reviews(fx.table(spark, sf, "performance_reviews_raw")).withColumn(
                  "review_period", F.expr(REVIEW_PERIOD)),
              "budget_allocations": fx.table(spark, sf, "budget_allocations")}
    return dq.constraint_checks(_constraints(), tables)

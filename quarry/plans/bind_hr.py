"""HR bindings: cleaning (B1-B14), filters (C1, C2, C7), department summaries (D1-D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cleaning as cl
from quarry.operators import summaries as sm
from quarry.plans import fixtures as fx
from quarry.plans.catalog import clip_sql, lower_strip_sql, query, titlecase_sql

AS_OF = fx.AS_OF


def employees_raw(spark, sf):
    return fx.table(spark, sf, "employees_raw")


def clean_employees_df(spark, sf):
    return cl.clean_employees(employees_raw(spark, sf))


def employees_with_tenure(spark, sf):
    return cl.tenure_years(clean_employees_df(spark, sf), AS_OF)


# Oracle CTE: cleaned employees (B1), built from the fixture view in plain DuckDB SQL.
EMP_COLS_SQL = f"""employee_id,
    {titlecase_sql('first_name')} AS first_name,
    {titlecase_sql('last_name')} AS last_name,
    {lower_strip_sql('email')} AS email,
    {lower_strip_sql('department')} AS department,
    TRY_CAST(salary AS DOUBLE) AS salary,
    CAST(TRY_STRPTIME(hire_date, '%Y-%m-%d') AS DATE) AS hire_date,
    {clip_sql('TRY_CAST(performance_rating AS DOUBLE)', '0.0', '5.0')} AS performance_rating,
    {lower_strip_sql('status')} AS status,
    birth_date"""

CLEAN_SQL = (fx.cte("employees_raw")[:-1] + f""",
emp_std AS (SELECT {EMP_COLS_SQL} FROM employees_raw),
clean AS (SELECT * FROM emp_std
          WHERE contains(email, '@') AND salary IS NOT NULL AND hire_date IS NOT NULL),
tenure AS (SELECT *, round(datediff('day', hire_date, DATE '{AS_OF}') / 365.25, 2) AS tenure_years
           FROM clean)
""")

SEL_EMP = ("employee_id, first_name, last_name, email, department, salary, hire_date, "
           "performance_rating, status, birth_date")


@query("clean_employees", CLEAN_SQL + f"SELECT {SEL_EMP} FROM clean")
def q_clean_employees(spark, sf):
    return clean_employees_df(spark, sf)


@query("standardize_names", fx.cte("employees_raw") + f"""SELECT employee_id,
  {titlecase_sql('first_name')} AS first_name, {titlecase_sql('last_name')} AS last_name
FROM employees_raw""")
def q_standardize_names(spark, sf):
    return cl.standardize_names(employees_raw(spark, sf)).select(
        "employee_id", "first_name", "last_name")


@query("rejected_employees", CLEAN_SQL + """SELECT employee_id, email, salary, hire_date,
  list_filter([CASE WHEN NOT coalesce(contains(email, '@'), false) THEN 'email' END,
               CASE WHEN salary IS NULL THEN 'salary' END,
               CASE WHEN hire_date IS NULL THEN 'hire_date' END], lambda r: r IS NOT NULL) AS reasons
FROM emp_std
WHERE NOT coalesce(contains(email, '@') AND salary IS NOT NULL AND hire_date IS NOT NULL, false)""")
def q_rejected(spark, sf):
    return cl.rejected_employees(employees_raw(spark, sf)).select(
        "employee_id", "email", "salary", "hire_date", "reasons")


@query("tenure_years", CLEAN_SQL + "SELECT employee_id, hire_date, tenure_years FROM tenure")
def q_tenure(spark, sf):
    return employees_with_tenure(spark, sf).select("employee_id", "hire_date", "tenure_years")


@query("experience_level", CLEAN_SQL + """SELECT employee_id, tenure_years,
  CASE WHEN tenure_years < 1 THEN 'New Hire' WHEN tenure_years < 3 THEN 'Junior'
       WHEN tenure_years < 7 THEN 'Mid-level' WHEN tenure_years < 15 THEN 'Senior'
       ELSE 'Veteran' END AS experience_level
FROM tenure""")
def q_experience(spark, sf):
    return cl.experience_level(employees_with_tenure(spark, sf)).select(
        "employee_id", "tenure_years", "experience_level")


@query("performance_category", CLEAN_SQL + """SELECT employee_id, performance_rating,
  CASE WHEN performance_rating >= 4.5 THEN 'Exceptional'
       WHEN performance_rating >= 4.0 THEN 'High Performer'
       WHEN performance_rating >= 3.5 THEN 'Good Performer'
       WHEN performance_rating >= 3.0 THEN 'Meets Expectations'
       ELSE 'Needs Improvement' END AS performance_category
FROM clean""")
def q_perf_cat(spark, sf):
    return cl.performance_category(clean_employees_df(spark, sf)).select(
        "employee_id", "performance_rating", "performance_category")


@query("performance_two_way", CLEAN_SQL + """SELECT employee_id, performance_rating,
  CASE WHEN performance_rating > 4.0 THEN 'High Performer' ELSE 'Regular' END AS performance_category
FROM clean""")
def q_perf_two(spark, sf):
    return cl.performance_two_way(clean_employees_df(spark, sf)).select(
        "employee_id", "performance_rating", "performance_category")


@query("active_employees", CLEAN_SQL + f"SELECT {SEL_EMP} FROM clean WHERE status = 'active'")
def q_active(spark, sf):
    return cl.active_only(clean_employees_df(spark, sf))


DEPT_SALARY_SQL = CLEAN_SQL + """SELECT department, round(avg(salary), 6) AS avg_salary,
  count(employee_id) AS headcount, round(avg(performance_rating), 6) AS avg_performance
FROM clean WHERE status = 'active' GROUP BY department"""


@query("dept_salary", DEPT_SALARY_SQL)
def q_dept_salary(spark, sf):
    """Flagship: raw employees → cleaning → active filter → department aggregate."""
    return sm.department_salary(clean_employees_df(spark, sf))


@query("dept_profile", CLEAN_SQL + """SELECT department, count(employee_id) AS headcount,
  round(avg(salary), 6) AS avg_salary, round(median(salary), 6) AS median_salary,
  min(salary) AS min_salary, max(salary) AS max_salary,
  round(avg(performance_rating), 6) AS avg_performance,
  min(hire_date) AS earliest_hire, max(hire_date) AS latest_hire
FROM clean GROUP BY department""")
def q_dept_profile(spark, sf):
    return sm.department_profile(clean_employees_df(spark, sf))


@query("dept_summary", CLEAN_SQL + """SELECT department, count(employee_id) AS headcount,
  round(avg(salary), 6) AS avg_salary, round(avg(tenure_years), 6) AS avg_tenure,
  round(sum(salary), 2) AS total_payroll
FROM tenure GROUP BY department""")
def q_dept_summary(spark, sf):
    return sm.department_summary(employees_with_tenure(spark, sf))


@query("dept_salary_point", CLEAN_SQL + """SELECT department, avg_salary FROM (
  SELECT department, round(avg(salary), 6) AS avg_salary FROM clean
  WHERE status = 'active' GROUP BY department) WHERE department = 'engineering'""")
def q_dept_point(spark, sf):
    return sm.point_value(sm.department_salary(clean_employees_df(spark, sf)),
                          "department", "engineering", "avg_salary")


@query("table_counts", CLEAN_SQL + """SELECT count(*) AS row_count,
  CAST(count_if(NOT coalesce(contains(email, '@'), false)) AS BIGINT) AS bad_email,
  CAST(count_if(salary IS NULL) AS BIGINT) AS null_salary,
  CAST(count_if(hire_date IS NULL) AS BIGINT) AS null_hire_date,
  CAST(count_if(status = 'active') AS BIGINT) AS active
FROM emp_std""")
def q_table_counts(spark, sf):
    df = employees_raw(spark, sf).withColumns(cl.employee_columns())
    return sm.table_counts(df, {
        "bad_email": ~F.coalesce(F.col("email").contains("@"), F.lit(False)),
        "null_salary": F.col("salary").isNull(),
        "null_hire_date": F.col("hire_date").isNull(),
        "active": F.col("status") == "active",
    })


@query("total_headcount", CLEAN_SQL + """SELECT CAST(sum(headcount) AS BIGINT) AS total_headcount
FROM (SELECT department, count(employee_id) AS headcount FROM clean GROUP BY department)""")
def q_total_headcount(spark, sf):
    per_dept = sm.department_summary(employees_with_tenure(spark, sf))
    return sm.column_total(per_dept, "headcount", "total_headcount")


@query("clean_reviews", fx.cte("performance_reviews_raw") + f"""SELECT review_id, employee_id,
  reviewer_id, CAST(TRY_STRPTIME(review_date, '%Y-%m-%d') AS DATE) AS review_date,
  {clip_sql('TRY_CAST(rating AS DOUBLE)', '1.0', '5.0')} AS rating,
  TRY_CAST(goals_met AS BOOLEAN) AS goals_met
FROM performance_reviews_raw""")
def q_clean_reviews(spark, sf):
    return cl.clean_reviews(fx.table(spark, sf, "performance_reviews_raw"))

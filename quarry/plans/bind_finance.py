"""Finance bindings: B10, B11, D4, D14-D16, E1-E4, E8, F6-F8 and the K questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cleaning as cl
from quarry.operators import finance as fn
from quarry.operators import joins as jn
from quarry.operators import summaries as sm
from quarry.plans import fixtures as fx
from quarry.plans.bind_hr import CLEAN_SQL, clean_employees_df
from quarry.plans.catalog import clip_sql, lower_strip_sql, query


def expenses_clean(spark, sf):
    return cl.clean_expenses(fx.table(spark, sf, "expenses_raw"))


def budgets_clean(spark, sf):
    return cl.budget_utilization(fx.table(spark, sf, "budgets_raw"))


EXP_CLEAN_SQL = fx.cte("expenses_raw")[:-1] + f""",
exp_std AS (SELECT expense_id, employee_id, department_id, {lower_strip_sql('category')} AS category,
  TRY_CAST(amount AS DOUBLE) AS amount,
  CAST(TRY_STRPTIME(expense_date, '%Y-%m-%d') AS DATE) AS expense_date,
  {lower_strip_sql('status')} AS status FROM expenses_raw),
exp_clean AS (SELECT *, CAST(year(expense_date) AS INTEGER) AS fiscal_year,
  CAST(quarter(expense_date) AS INTEGER) AS fiscal_quarter FROM exp_std WHERE amount > 0)
"""

BUDGET_SQL = fx.cte("budgets_raw")[:-1] + f""",
budgets AS (SELECT budget_id, department_id, {lower_strip_sql('department')} AS department,
  fiscal_year, quarter, CAST(budget_amount AS DOUBLE) AS budget_amount,
  CAST(allocated_amount AS DOUBLE) AS allocated_amount, spent_amount,
  round(allocated_amount / NULLIF(budget_amount, 0) * 100, 2) AS utilization_percent
  FROM budgets_raw)
"""


@query("clean_expenses", EXP_CLEAN_SQL + "SELECT * FROM exp_clean")
def q_clean_expenses(spark, sf):
    return expenses_clean(spark, sf)


@query("budget_utilization", BUDGET_SQL + "SELECT * FROM budgets")
def q_budget_util(spark, sf):
    return budgets_clean(spark, sf)


@query("expense_summary", EXP_CLEAN_SQL + """SELECT category, round(sum(amount), 2) AS total_amount,
  round(avg(amount), 6) AS avg_amount, count(expense_id) AS transaction_count
FROM exp_clean GROUP BY category""")
def q_expense_summary(spark, sf):
    return sm.expense_summary(expenses_clean(spark, sf))


@query("budget_variance", BUDGET_SQL + """SELECT department,
  round(sum(budget_amount), 6) AS total_budget, round(sum(allocated_amount), 6) AS total_allocated,
  round(sum(spent_amount), 6) AS total_spent, CAST(grouping(department) AS INTEGER) AS is_total,
  round(sum(allocated_amount) / NULLIF(sum(budget_amount), 0) * 100, 2) AS utilization_percent,
  round(sum(budget_amount) - sum(spent_amount), 6) AS variance
FROM budgets GROUP BY ROLLUP (department)""")
def q_budget_variance(spark, sf):
    return fn.budget_variance(budgets_clean(spark, sf))


@query("cost_per_employee", CLEAN_SQL[:-1] + ",\n" + EXP_CLEAN_SQL[5:-1] + """,
q AS (SELECT fiscal_year, fiscal_quarter, sum(amount) AS total, count(DISTINCT employee_id) AS spenders FROM exp_clean GROUP BY ALL)
SELECT fiscal_year, fiscal_quarter, round(total, 2) AS total_expense, spenders AS spending_employees,
  (SELECT count(*) FROM clean c WHERE c.hire_date < make_date(fiscal_year, 3 * fiscal_quarter - 2, 1) + INTERVAL 3 MONTH) AS headcount,
  round(total / nullif((SELECT count(*) FROM clean c
    WHERE c.hire_date < make_date(fiscal_year, 3 * fiscal_quarter - 2, 1) + INTERVAL 3 MONTH), 0), 6) AS cost_per_employee
FROM q""")
def q_cost_per_employee(spark, sf):
    out = fn.cost_per_employee(expenses_clean(spark, sf), clean_employees_df(spark, sf))
    return out.withColumns({"total_expense": F.round("total_expense", 2), "cost_per_employee": F.round("cost_per_employee", 6)})


@query("financial_report", EXP_CLEAN_SQL[:-1] + ",\n" + fx.cte("revenue")[5:] + """,
rev AS (SELECT CAST(year(revenue_date) AS INTEGER) AS fiscal_year,
  CAST(quarter(revenue_date) AS INTEGER) AS fiscal_quarter, sum(amount) AS revenue
  FROM revenue GROUP BY ALL),
ex AS (SELECT fiscal_year, fiscal_quarter, sum(amount) AS expenses FROM exp_clean GROUP BY ALL)
SELECT coalesce(rev.fiscal_year, ex.fiscal_year) AS fiscal_year,
  coalesce(rev.fiscal_quarter, ex.fiscal_quarter) AS fiscal_quarter,
  round(revenue, 2) AS revenue, round(expenses, 2) AS expenses,
  round(coalesce(revenue, 0) - coalesce(expenses, 0), 2) AS net_income
FROM rev FULL OUTER JOIN ex ON rev.fiscal_year = ex.fiscal_year AND rev.fiscal_quarter = ex.fiscal_quarter""")
def q_financial_report(spark, sf):
    return fn.financial_report(fx.table(spark, sf, "revenue"), expenses_clean(spark, sf))


@query("expense_share", EXP_CLEAN_SQL + """SELECT category, round(total, 2) AS total_amount,
  round(total / sum(total) OVER () * 100, 6) AS share_percent,
  CAST(dense_rank() OVER (ORDER BY total DESC) AS INTEGER) AS rank
FROM (SELECT category, sum(amount) AS total FROM exp_clean GROUP BY category)""")
def q_expense_share(spark, sf):
    return fn.expense_share(expenses_clean(spark, sf))


@query("expense_qoq", EXP_CLEAN_SQL + """SELECT fiscal_year, fiscal_quarter,
  round(total, 2) AS total_amount,
  round(total - lag(total) OVER w, 2) AS change,
  round((total - lag(total) OVER w) / NULLIF(lag(total) OVER w, 0) * 100, 6) AS change_percent
FROM (SELECT fiscal_year, fiscal_quarter, sum(amount) AS total FROM exp_clean GROUP BY ALL)
WINDOW w AS (ORDER BY fiscal_year * 4 + fiscal_quarter - 1)""")
def q_expense_qoq(spark, sf):
    return fn.expense_qoq(expenses_clean(spark, sf))


@query("revenue_yoy", fx.cte("revenue")[:-1] + """,
per AS (SELECT stream, year(revenue_date) * 4 + quarter(revenue_date) - 1 AS qi, sum(amount) AS amount
        FROM revenue GROUP BY ALL),
axis AS (SELECT stream, unnest(range(min(qi), max(qi) + 1)) AS qi FROM per GROUP BY stream),
dense AS (SELECT a.stream, a.qi, coalesce(p.amount, 0.0) AS amount
          FROM axis a LEFT JOIN per p ON a.stream = p.stream AND a.qi = p.qi)
SELECT stream, CAST(floor(qi / 4) AS INTEGER) AS fiscal_year, CAST(qi % 4 + 1 AS INTEGER) AS fiscal_quarter,
  round(amount, 2) AS revenue,
  round((amount - lag(amount, 4) OVER w) / NULLIF(lag(amount, 4) OVER w, 0) * 100, 6) AS yoy_percent,
  round(amount / NULLIF(sum(amount) OVER (PARTITION BY qi), 0) * 100, 6) AS share_percent
FROM dense WINDOW w AS (PARTITION BY stream ORDER BY qi)""")
def q_revenue_yoy(spark, sf):
    return fn.revenue_yoy(fx.table(spark, sf, "revenue"))


@query("revenue_projection", fx.cte("revenue")[:-1] + """,
per AS (SELECT year(revenue_date) * 4 + quarter(revenue_date) - 1 AS qi, sum(amount) AS revenue
        FROM revenue GROUP BY ALL),
g AS (SELECT qi, revenue, revenue / NULLIF(lag(revenue) OVER (ORDER BY qi), 0) - 1 AS growth FROM per)
SELECT CAST(floor(max(qi) / 4) AS INTEGER) AS last_year, CAST(max(qi) % 4 + 1 AS INTEGER) AS last_quarter,
  round(arg_max(revenue, qi), 2) AS last_revenue, round(avg(growth), 6) AS mean_growth,
  round(arg_max(revenue, qi) * (1 + avg(growth)), 2) AS projected_revenue FROM g""")
def q_revenue_projection(spark, sf):
    return fn.revenue_projection(fx.table(spark, sf, "revenue"))


@query("expense_month", EXP_CLEAN_SQL + """SELECT category, round(sum(amount), 2) AS total_amount,
  round(avg(amount), 6) AS avg_amount, count(expense_id) AS transaction_count
FROM exp_clean WHERE date_trunc('month', expense_date) =
  (SELECT max(date_trunc('month', expense_date)) FROM exp_clean) GROUP BY category""")
def q_expense_month(spark, sf):
    return sm.expense_summary(fn.latest_month(expenses_clean(spark, sf)))


@query("approved_expenses", EXP_CLEAN_SQL + "SELECT * FROM exp_clean WHERE status = 'approved'")
def q_approved(spark, sf):
    return expenses_clean(spark, sf).filter(F.col("status") == "approved")


@query("expense_by_department", EXP_CLEAN_SQL[:-1] + ",\n" + CLEAN_SQL[5:-1] + ",\n"
       + fx.cte("departments")[5:] + """SELECT d.department_name,
  round(sum(e.amount), 2) AS total_amount, count(e.expense_id) AS expense_count,
  CAST(count_if(c.employee_id IS NULL) AS BIGINT) AS unknown_employee_rows
FROM exp_clean e JOIN departments d ON e.department_id = d.department_id
LEFT JOIN clean c ON e.employee_id = c.employee_id GROUP BY d.department_name""")
def q_expense_by_dept(spark, sf):
    return jn.expense_by_department(expenses_clean(spark, sf), fx.table(spark, sf, "departments"),
                                    clean_employees_df(spark, sf))


@query("budget_allocation", BUDGET_SQL[:-1] + ",\n" + fx.cte("budget_allocations", "departments")[5:] + """
SELECT b.budget_id, b.department_id, d.department_name, b.quarter,
  round(b.budget_amount, 6) AS budget_amount, coalesce(a.allocations, 0) AS allocations,
  round(coalesce(a.alloc_allocated, 0.0), 6) AS allocated_amount,
  round(coalesce(a.alloc_spent, 0.0), 6) AS spent_amount
FROM budgets b
LEFT JOIN (SELECT budget_id, count(allocation_id) AS allocations, sum(allocated_amount) AS alloc_allocated,
           sum(spent_amount) AS alloc_spent FROM budget_allocations GROUP BY budget_id) a
  ON b.budget_id = a.budget_id
LEFT JOIN departments d ON b.department_id = d.department_id""")
def q_budget_allocation(spark, sf):
    return jn.budget_allocation(budgets_clean(spark, sf), fx.table(spark, sf, "budget_allocations"),
                                fx.table(spark, sf, "departments"))


REVIEWS_SQL = fx.cte("performance_reviews_raw")[5:-1] + f""",
reviews AS (SELECT review_id, employee_id, reviewer_id,
  CAST(TRY_STRPTIME(review_date, '%Y-%m-%d') AS DATE) AS review_date,
  {clip_sql('TRY_CAST(rating AS DOUBLE)', '1.0', '5.0')} AS rating FROM performance_reviews_raw)
"""


@query("review_pairs", CLEAN_SQL[:-1] + ",\n" + REVIEWS_SQL + """SELECT r.review_id, r.employee_id,
  CASE WHEN e.employee_id IS NOT NULL THEN concat_ws(' ', e.first_name, e.last_name) END AS employee_name,
  r.reviewer_id,
  CASE WHEN v.employee_id IS NOT NULL THEN concat_ws(' ', v.first_name, v.last_name) END AS reviewer_name, r.review_date, r.rating
FROM reviews r LEFT JOIN clean e ON r.employee_id = e.employee_id
LEFT JOIN clean v ON r.reviewer_id = v.employee_id""")
def q_review_pairs(spark, sf):
    reviews = cl.clean_reviews(fx.table(spark, sf, "performance_reviews_raw"))
    return jn.review_pairs(reviews, clean_employees_df(spark, sf))


@query("department_managers", CLEAN_SQL[:-1] + ",\n" + fx.cte("departments")[5:] + """
SELECT d.department_id, d.department_name, d.manager_id,
  CASE WHEN e.employee_id IS NOT NULL THEN concat_ws(' ', e.first_name, e.last_name) END AS manager_name
FROM departments d LEFT JOIN clean e ON d.manager_id = e.employee_id""")
def q_dept_managers(spark, sf):
    return jn.department_managers(fx.table(spark, sf, "departments"), clean_employees_df(spark, sf))


# (child view, foreign key, parent view, key, name)
REFERENCES = [
    ("expenses_raw", "employee_id", "employees_raw", "employee_id", "expenses.employee_id"),
    ("expenses_raw", "department_id", "departments", "department_id", "expenses.department_id"),
    ("departments", "manager_id", "employees_raw", "employee_id", "departments.manager_id"),
    ("performance_reviews_raw", "employee_id", "employees_raw", "employee_id", "performance_reviews.employee_id"),
    ("performance_reviews_raw", "reviewer_id", "employees_raw", "employee_id", "performance_reviews.reviewer_id"),
    ("budgets_raw", "department_id", "departments", "department_id", "budgets.department_id"),
    ("budget_allocations", "budget_id", "budgets_raw", "budget_id", "budget_allocations.budget_id"),
]


@query("orphan_keys", fx.cte(*dict.fromkeys(v for c, _, p, _, _ in REFERENCES for v in (c, p))) + "\nUNION ALL ".join(
    f"SELECT '{name}' AS constraint_name, count(*) AS orphan_rows, count(DISTINCT {fk}) AS orphan_keys FROM {child} x "
    f"WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = x.{fk})"
    for child, fk, parent, key, name in REFERENCES))
def q_orphans(spark, sf):
    return jn.orphan_report([(fx.table(spark, sf, c), fk, fx.table(spark, sf, p), key, name)
                             for c, fk, p, key, name in REFERENCES])

"""Finance jobs: budget roll-ups, quarterly cost and revenue series, shares and growth.

Pattern used throughout: aggregate the big table first (map-side partial aggregation, one
shuffle on a small key), and only then apply windows — the windows run over a result with
one row per quarter/category, so an un-partitioned ``over ()`` never sees the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def quarter_index(year_col, quarter_col):
    return F.col(year_col) * 4 + F.col(quarter_col) - 1


def budget_variance(budgets: DataFrame) -> DataFrame:
    """Overall and per-department totals in one pass (rollup): budget, allocated, spent,
    utilisation % = allocated / budget (null when budget is 0) and variance = budget − spent."""
    return (budgets.rollup("department")
            .agg(F.sum("budget_amount").alias("total_budget"),
                 F.sum("allocated_amount").alias("total_allocated"),
                 F.sum("spent_amount").alias("total_spent"),
                 F.grouping("department").cast("int").alias("is_total"))
            .withColumn("utilization_percent",
                        F.round(F.try_divide(F.col("total_allocated"), F.col("total_budget")) * 100, 2))
            .withColumn("variance", (F.col("total_budget") - F.col("total_spent"))))


def cost_per_employee(expenses: DataFrame, employees: DataFrame) -> DataFrame:
    """Per fiscal quarter: total expense, employees who spent, headcount (employees hired by the
    quarter's end) and cost per head. Two aggregates, one row a quarter each, joined on it."""
    spent = expenses.groupBy("fiscal_year", "fiscal_quarter").agg(
        F.sum("amount").alias("total_expense"), F.count_distinct("employee_id").alias("spending_employees"))
    index = quarter_index("fiscal_year", "fiscal_quarter")
    hired = employees.filter("hire_date is not null").groupBy(
        (F.year("hire_date") * 4 + F.quarter("hire_date") - 1).alias("q")).agg(F.count(F.lit(1)).alias("hired"))
    # hires and quarters asked about on one axis of quarters, then a running sum over it
    axis = hired.select("q", "hired").unionByName(spent.select(index.alias("q"), F.lit(0).cast("long").alias("hired")))
    axis = axis.groupBy("q").agg(F.sum("hired").alias("hired"))
    heads = axis.select("q", F.sum("hired").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)).alias("headcount"))
    return spent.withColumn("q", index).join(heads, "q").select(
        "fiscal_year", "fiscal_quarter", "total_expense", "spending_employees", "headcount",
        F.try_divide(F.col("total_expense"), F.col("headcount")).alias("cost_per_employee"))


def quarterly_revenue(revenue: DataFrame, date_col: str = "revenue_date") -> DataFrame:
    return (revenue.groupBy(F.year(date_col).alias("fiscal_year"),
                            F.quarter(date_col).alias("fiscal_quarter"))
            .agg(F.sum("amount").alias("revenue")))


def financial_report(revenue: DataFrame, expenses: DataFrame) -> DataFrame:
    """Revenue, expenses and net income per quarter: full outer join of two quarterly sums."""
    rev = quarterly_revenue(revenue)
    exp = (expenses.groupBy("fiscal_year", "fiscal_quarter")
           .agg(F.sum("amount").alias("expenses")))
    joined = rev.join(exp, ["fiscal_year", "fiscal_quarter"], "full_outer")
    return joined.select(
        "fiscal_year", "fiscal_quarter",
        "revenue", "expenses",
        (F.coalesce("revenue", F.lit(0.0)) - F.coalesce("expenses", F.lit(0.0))).alias("net_income"))


def expense_share(expenses: DataFrame) -> DataFrame:
    """Category totals, share of the grand total and rank (window over the category result)."""
    per_cat = expenses.groupBy("category").agg(F.sum("amount").alias("total"))
    w_all = Window.partitionBy()
    return per_cat.select(
        "category", F.col("total").alias("total_amount"),
        (F.col("total") / F.sum("total").over(w_all) * 100).alias("share_percent"),
        F.dense_rank().over(Window.orderBy(F.col("total").desc())).alias("rank"))


def expense_qoq(expenses: DataFrame) -> DataFrame:
    """Quarterly expense with change on the previous quarter (lag over the quarter series)."""
    per_q = (expenses.groupBy("fiscal_year", "fiscal_quarter")
             .agg(F.sum("amount").alias("total")))
    w = Window.orderBy(quarter_index("fiscal_year", "fiscal_quarter"))
    prev = F.lag("total").over(w)
    return per_q.select(
        "fiscal_year", "fiscal_quarter", F.col("total").alias("total_amount"),
        (F.col("total") - prev).alias("change"),
        (F.try_divide(F.col("total") - prev, prev) * 100).alias("change_percent"))


def dense_quarter_axis(df: DataFrame, key: str) -> DataFrame:
    """Every quarter between each key's first and last quarter (a generator, not a cross join)."""
    bounds = df.groupBy(key).agg(F.min("qi").alias("lo"), F.max("qi").alias("hi"))
    return bounds.select(key, F.explode(F.sequence("lo", "hi")).alias("qi"))


def revenue_yoy(revenue: DataFrame, stream_col: str = "stream") -> DataFrame:
    """Revenue by stream and quarter on a dense quarter axis, year-on-year growth (lag 4) and
    the stream's share of the quarter."""
    per = (revenue.groupBy(stream_col,
                           (F.year("revenue_date") * 4 + F.quarter("revenue_date") - 1).alias("qi"))
           .agg(F.sum("amount").alias("amount")))
    axis = dense_quarter_axis(per, stream_col)
    dense = axis.join(per, [stream_col, "qi"], "left").withColumn(
        "amount", F.coalesce("amount", F.lit(0.0)))
    w_stream = Window.partitionBy(stream_col).orderBy("qi")
    w_q = Window.partitionBy("qi")
    last_year = F.lag("amount", 4).over(w_stream)
    return dense.select(
        stream_col,
        F.floor(F.col("qi") / 4).cast("int").alias("fiscal_year"),
        (F.col("qi") % 4 + 1).cast("int").alias("fiscal_quarter"),
        F.col("amount").alias("revenue"),
        (F.try_divide(F.col("amount") - last_year, last_year) * 100).alias("yoy_percent"),
        (F.try_divide(F.col("amount"), F.sum("amount").over(w_q)) * 100).alias("share_percent"))


def revenue_projection(revenue: DataFrame) -> DataFrame:
    """Next quarter = last quarter's revenue × (1 + mean quarter-on-quarter growth)."""
    per_q = (revenue.groupBy((F.year("revenue_date") * 4 + F.quarter("revenue_date") - 1).alias("qi"))
             .agg(F.sum("amount").alias("revenue")))
    w = Window.orderBy("qi")
    growth = per_q.withColumn("growth", F.try_divide(F.col("revenue"), F.lag("revenue").over(w)) - 1)
    return growth.agg(
        F.max("qi").alias("last_qi"),
        F.max_by("revenue", "qi").alias("last_revenue"),
        F.avg("growth").alias("mean_growth")).select(
        F.floor(F.col("last_qi") / 4).cast("int").alias("last_year"),
        (F.col("last_qi") % 4 + 1).cast("int").alias("last_quarter"),
        "last_revenue",
        "mean_growth",
        (F.col("last_revenue") * (1 + F.col("mean_growth"))).alias("projected_revenue"))


def latest_month(expenses: DataFrame, date_col: str = "expense_date") -> DataFrame:
    """Rows of the most recent calendar month present (scalar subquery on the max date)."""
    last = expenses.agg(F.max(F.trunc(date_col, "month")))
    return expenses.filter(F.trunc(date_col, "month") == last.scalar())

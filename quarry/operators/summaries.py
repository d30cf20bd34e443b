"""Group-by summaries. Each is one hash aggregate with a map-side partial step, so the shuffle
carries one row per (task, group) however many rows a hot group holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.quantiles import exact_quantiles




def department_salary(df: DataFrame) -> DataFrame:
    """Active employees per department: mean salary, headcount (non-null ids), mean rating."""
    return (df.filter(F.col("status") == "active")
              .groupBy("department")
              .agg(F.avg("salary").alias("avg_salary"),
                   F.count("employee_id").alias("headcount"),
                   F.avg("performance_rating").alias("avg_performance")))


def department_profile(df: DataFrame) -> DataFrame:
    """Per department: count, mean, exact (interpolated) median, min, max salary, mean rating,
    first and last hire; sorted by mean salary descending with nulls first.

    The median is selected by distributed ranking (``quantiles``) rather than ``median()``,
    which would buffer every salary of a department in the task that finishes the group.
    """
    agg = (df.groupBy("department")
             .agg(F.count("employee_id").alias("headcount"),
                  F.avg("salary").alias("avg_salary"),
                  F.min("salary").alias("min_salary"),
                  F.max("salary").alias("max_salary"),
                  F.avg("performance_rating").alias("avg_performance"),
                  F.min("hire_date").alias("earliest_hire"),
                  F.max("hire_date").alias("latest_hire")))
    med = exact_quantiles(df, ["department"], "salary", {"median_salary": 0.5})
    med = med.select(F.col("department").alias("__d"), F.col("median_salary").alias("median_salary"))
    out = agg.join(med, agg["department"].eqNullSafe(med["__d"]), "left").drop("__d")
    return (out.select("department", "headcount", "avg_salary", "median_salary", "min_salary",
                       "max_salary", "avg_performance", "earliest_hire", "latest_hire")
               .orderBy(F.col("avg_salary").desc_nulls_first()))


def department_summary(df: DataFrame) -> DataFrame:
    return (df.groupBy("department")
              .agg(F.count("employee_id").alias("headcount"),
                   F.avg("salary").alias("avg_salary"),
                   F.avg("tenure_years").alias("avg_tenure"),
                   F.sum("salary").alias("total_payroll")))


def expense_summary(df: DataFrame) -> DataFrame:
    return (df.groupBy("category")
              .agg(F.sum("amount").alias("total_amount"),
                   F.avg("amount").alias("avg_amount"),
                   F.count("expense_id").alias("transaction_count"))
              .orderBy(F.col("total_amount").desc_nulls_first()))


def table_counts(df: DataFrame, predicates: dict) -> DataFrame:
    """Row count plus one ``count_if`` per named predicate, all in a single scan."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count_if(p).alias(name) for name, p in predicates.items()]
    return df.agg(*aggs)


def column_total(df: DataFrame, col: str, alias: str) -> DataFrame:
    return df.agg(F.sum(col).alias(alias))


def point_value(df: DataFrame, key_col: str, key, value_col: str) -> DataFrame:
    """Point filter then the single value column (e.g. one department's mean salary)."""
    return df.filter(F.col(key_col) == key).select(key_col, value_col)

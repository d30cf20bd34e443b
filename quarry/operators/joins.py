"""Joins implied by the warehouse foreign keys.

Dimension tables (departments, rule tables, holiday lists) are broadcast only behind a size
check (``broadcast_if_small``); above the limit the join falls back to a shuffle join that
AQE can still convert at runtime. Fact-to-fact joins pre-aggregate the many side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.partitioning import broadcast_if_small

def expense_by_department(expenses: DataFrame, departments: DataFrame,
                          employees: DataFrame) -> DataFrame:
    """Expenses with their department (FK) and employee (FK, kept when missing).

    Expenses are first reduced to one row per (department, employee) with a partial
    aggregate, so the join with the employee table moves one row per pair instead of every
    expense, and a hot employee costs one row per map task.
    """
    pairs = expenses.groupBy("department_id", "employee_id").agg(
        F.sum("amount").alias("amount"), F.count("expense_id").alias("n"))
    depts = broadcast_if_small(departments.select("department_id", "department_name"))
    emps = employees.select("employee_id", F.lit(True).alias("known_employee")).dropDuplicates(["employee_id"])
    joined = pairs.join(depts, "department_id", "inner").join(emps, "employee_id", "left")
    return (joined.groupBy("department_name")
            .agg(F.sum("amount").alias("total_amount"),
                 F.sum("n").alias("expense_count"),
                 F.coalesce(F.sum(F.when(F.col("known_employee").isNull(), F.col("n"))), F.lit(0))
                 .alias("unknown_employee_rows")))


def budget_allocation(budgets: DataFrame, allocations: DataFrame,
                      departments: DataFrame) -> DataFrame:
    """Budgets with their allocations summed per budget (pre-aggregated before the join) and
    the department name; budgets without an allocation are kept."""
    per_budget = (allocations.groupBy("budget_id")
                  .agg(F.count("allocation_id").alias("allocations"),
                       F.sum("allocated_amount").alias("alloc_allocated"),
                       F.sum("spent_amount").alias("alloc_spent")))
    depts = broadcast_if_small(departments.select("department_id", "department_name"))
    return (budgets.join(per_budget, "budget_id", "left")
            .join(depts, "department_id", "left")
            .select("budget_id", "department_id", "department_name", "quarter",
                    "budget_amount",
                    F.coalesce("allocations", F.lit(0)).alias("allocations"),
                    F.coalesce("alloc_allocated", F.lit(0.0)).alias("allocated_amount"),
                    F.coalesce("alloc_spent", F.lit(0.0)).alias("spent_amount")))


def review_pairs(reviews: DataFrame, employees: DataFrame) -> DataFrame:
    """Each review with the reviewed and the reviewing employee (two roles of one table)."""
    person = employees.select("employee_id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    reviewed = person.withColumnRenamed("name", "employee_name")
    reviewer = person.withColumnRenamed("employee_id", "reviewer_id").withColumnRenamed(
        "name", "reviewer_name")
    return (reviews.join(reviewed, "employee_id", "left")
            .join(reviewer, "reviewer_id", "left")
            .select("review_id", "employee_id", "employee_name", "reviewer_id", "reviewer_name",
                    "review_date", "rating"))


def department_managers(departments: DataFrame, employees: DataFrame) -> DataFrame:
    mgr = employees.select(F.col("employee_id").alias("manager_id"),
                           F.concat_ws(" ", "first_name", "last_name").alias("manager_name"))
    return departments.join(mgr, "manager_id", "left").select(
        "department_id", "department_name", "manager_id", "manager_name")


def orphan_report(references: list[tuple]) -> DataFrame:
    """Per reference ``(child, fk, parent, key, name)``: rows of the child whose foreign key has no
    parent row, and how many keys they hold. Children are reduced to one row per key before the
    anti join, parents to their keys."""
    out = None
    for child, fk, parent, key, name in references:
        per_key = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        lost = per_key.join(parent.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
        row = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")).select(
            F.lit(name).alias("constraint_name"), "orphan_rows", "orphan_keys")
        out = row if out is None else out.unionByName(row)
    return out

"""Value checks the reference's own tests make, on its five-row fixtures."""

from pyspark.sql import functions as F

from quarry.operators import cleaning as cl
from quarry.operators import routing as rt
from quarry.operators import summaries as sm

HR_ROWS = [
    (1, "John", "Doe", "Engineering", 85000, 4.5, "2022-01-15", "active"),
    (2, "Jane", "Smith", "Finance", 65000, 4.2, "2021-03-10", "active"),
    (3, "Bob", "Johnson", "HR", 75000, 4.8, "2020-05-20", "active"),
    (4, "Alice", "Brown", "Engineering", 90000, 4.1, "2022-06-01", "active"),
    (5, "Charlie", "Wilson", "Finance", 70000, 4.6, "2021-11-15", "active"),
]
HR_SCHEMA = ("employee_id long, first_name string, last_name string, department string, salary long, "
             "performance_rating double, hire_date string, status string")


def _transformed(spark):
    df = spark.createDataFrame(HR_ROWS, HR_SCHEMA).withColumns({
        "hire_date": cl.to_date("hire_date", strict=True),
        "salary": F.col("salary").cast("double"),
        "department": F.lower("department")})
    return sm.department_salary(df)


def test_engineering_average_salary(spark):
    out = {r["department"]: r for r in _transformed(spark).collect()}
    assert out["engineering"]["avg_salary"] == 87500.0


def test_hr_average_performance(spark):
    out = {r["department"]: r for r in _transformed(spark).collect()}
    assert out["hr"]["avg_performance"] == 4.8


def test_total_headcount(spark):
    assert sm.column_total(_transformed(spark), "headcount", "t").first()["t"] == 5


ROUTES = [
    ("What is the employee performance rating?", "hr"), ("employee performance", "hr"),
    ("recruitment process", "hr"), ("What is the budget allocation?", "finance"),
    ("budget analysis", "finance"), ("expense report", "finance"),
    ("How can I help you today?", "general"), ("hello there", "general"),
]


def test_routing_labels(spark):
    df = spark.createDataFrame(ROUTES, "query string, expected string")
    for rules in (rt.ORCHESTRATOR_RULES, rt.AGENT_RULES):
        got = rt.route(df, "query", rules).collect()
        assert all(r["route"] == r["expected"] for r in got), got


def test_routing_is_substring(spark):
    df = spark.createDataFrame([("three apples",)], "query string")
    assert rt.route(df, "query", rt.AGENT_RULES).first()["route"] == "hr"

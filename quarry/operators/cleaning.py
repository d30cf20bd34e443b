"""Per-table cleaning jobs: one projection + filter each, all built-in expressions.

Every function takes a DataFrame and returns a DataFrame; nothing is collected. Casts of
text use ``try_cast`` / ``try_to_date`` (bad value → null) unless ``strict=True``, in which
case ANSI semantics raise on the first bad value, as the strict reader of the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import lower_strip, titlecase


def to_double(c: Column | str, strict: bool = False) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double") if strict else col.try_cast("double")


def to_date(c: Column | str, fmt: str = "yyyy-MM-dd", strict: bool = False) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.to_date(col, fmt) if strict else F.try_to_date(col, fmt)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null (``greatest``/``least`` alone would skip nulls)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col)))


def standardize_names(df: DataFrame, cols=("first_name", "last_name")) -> DataFrame:
    return df.withColumns({c: titlecase(c) for c in cols})


def employee_columns(rating_bounds=(0.0, 5.0), strict: bool = False) -> dict[str, Column]:
    lo, hi = rating_bounds
    return {
        "first_name": titlecase("first_name"),
        "last_name": titlecase("last_name"),
        "email": lower_strip("email"),
        "department": lower_strip("department"),
        "salary": to_double("salary", strict),
        "hire_date": to_date("hire_date", strict=strict),
        "performance_rating": clip(to_double("performance_rating", strict), lo, hi),
        "status": lower_strip("status"),
    }


def valid_employee() -> Column:
    return (F.col("email").contains("@") & F.col("salary").isNotNull()
            & F.col("hire_date").isNotNull())


def clean_employees(df: DataFrame, rating_bounds=(0.0, 5.0), strict: bool = False) -> DataFrame:
    """Standardise eight employee columns then keep rows with '@' in email, salary, hire date."""
    return df.withColumns(employee_columns(rating_bounds, strict)).filter(valid_employee())


def rejected_employees(df: DataFrame, rating_bounds=(0.0, 5.0)) -> DataFrame:
    """The rows ``clean_employees`` drops, with the reason(s) as an array column."""
    cleaned = df.withColumns(employee_columns(rating_bounds))
    reasons = F.filter(F.array(
        F.when(~F.coalesce(F.col("email").contains("@"), F.lit(False)), F.lit("email")),
        F.when(F.col("salary").isNull(), F.lit("salary")),
        F.when(F.col("hire_date").isNull(), F.lit("hire_date")),
    ), lambda r: r.isNotNull())
    return cleaned.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def tenure_years(df: DataFrame, as_of: str, date_col: str = "hire_date") -> DataFrame:
    """Tenure = days since ``date_col`` / 365.25, rounded to 2 places, relative to ``as_of``."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.col(date_col))
    return df.withColumn("tenure_years", F.round(days / F.lit(365.25), 2))


def clean_reviews(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "review_date": to_date("review_date"),
        "rating": clip(to_double("rating"), 1.0, 5.0),
        "goals_met": F.col("goals_met").try_cast("boolean"),
    })


def clean_expenses(df: DataFrame) -> DataFrame:
    """Parse date and amount, normalise category/status, keep amount > 0, add fiscal year/quarter."""
    return (df.withColumns({
        "expense_date": to_date("expense_date"),
        "amount": to_double("amount"),
        "category": lower_strip("category"),
        "status": lower_strip("status"),
    }).filter(F.col("amount") > 0)
      .withColumns({"fiscal_year": F.year("expense_date"),
                    "fiscal_quarter": F.quarter("expense_date")}))


def budget_utilization(df: DataFrame) -> DataFrame:
    """utilization_percent = allocated / budget · 100 rounded to 2; budget 0 → null."""
    out = df.withColumns({
        "budget_amount": to_double("budget_amount"),
        "allocated_amount": to_double("allocated_amount"),
        "department": lower_strip("department"),
    })
    return out.withColumn("utilization_percent", F.round(
        F.try_divide(F.col("allocated_amount"), F.col("budget_amount")) * 100, 2))


# Experience levels by tenure (years) and performance steps by rating.
EXPERIENCE_STEPS = [(1, "New Hire"), (3, "Junior"), (7, "Mid-level"), (15, "Senior")]
EXPERIENCE_TOP = "Veteran"
PERFORMANCE_STEPS = [(4.5, "Exceptional"), (4.0, "High Performer"),
                     (3.5, "Good Performer"), (3.0, "Meets Expectations")]
PERFORMANCE_BOTTOM = "Needs Improvement"


def experience_level(df: DataFrame, tenure_col: str = "tenure_years") -> DataFrame:
    """Ordered ``tenure < step`` ladder; null tenure falls through to the top level."""
    t = F.col(tenure_col)
    expr = None
    for bound, label in EXPERIENCE_STEPS:
        expr = F.when(t < bound, label) if expr is None else expr.when(t < bound, label)
    return df.withColumn("experience_level", expr.otherwise(EXPERIENCE_TOP))


def performance_category(df: DataFrame, rating_col: str = "performance_rating") -> DataFrame:
    r = F.col(rating_col)
    expr = None
    for bound, label in PERFORMANCE_STEPS:
        expr = F.when(r >= bound, label) if expr is None else expr.when(r >= bound, label)
    return df.withColumn("performance_category", expr.otherwise(PERFORMANCE_BOTTOM))


def performance_two_way(df: DataFrame, rating_col: str = "performance_rating") -> DataFrame:
    return df.withColumn("performance_category", F.when(F.col(rating_col) > 4.0, "High Performer")
                         .otherwise("Regular"))


def active_only(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Exact ``status == 'active'`` (no trimming or case folding in this copy)."""
    return df.filter(F.col(status_col) == "active")

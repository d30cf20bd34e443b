"""Business calendar: a date dimension with a running business-day count and the next
business day of every date, joined to fact rows by plain equi-joins.

The calendar has one row per day between the earliest and latest date of the input (plus as many
days as its holidays can put off the next business day). The date type itself bounds it, at
3.7 million days, so it is broadcast. No per-row explode of date ranges happens on the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint


def build_calendar(bounds: DataFrame, holidays: DataFrame) -> DataFrame:
    """``bounds`` has one row with columns ``lo`` and ``hi`` (dates); ``holidays`` a column
    ``holiday``. Returns (d, is_bd, cum_bd, next_bd).

    Among the days after the last one there must be a weekday that is no holiday: every 7 days
    have 5 weekdays, so with ``h`` holidays ``7 * (h div 5 + 1)`` days hold one.
    """
    off = holidays.select(F.col("holiday").alias("d")).filter("d is not null").distinct()
    n = off.agg(F.count(F.lit(1)).alias("h")).scalar()
    ahead = (F.lit(7) * (F.floor(n / 5) + 1)).cast("int")
    days = bounds.select("lo", "hi", ahead.alias("ahead")).select(F.explode(F.sequence(
        F.col("lo"), F.date_add(F.col("hi"), F.col("ahead")))).alias("d"))
    cal = (days.join(off.withColumn("is_holiday", F.lit(True)), "d", "left")
           .withColumn("is_bd", (F.weekday("d") < 5) & F.col("is_holiday").isNull())
           .drop("is_holiday"))
    # the calendar is a bounded dimension: one ordered window over it is cheap
    w_run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.orderBy("d").rowsBetween(1, Window.unboundedFollowing)
    return cal.select(
        "d", "is_bd",
        F.sum(F.col("is_bd").cast("int")).over(w_run).alias("cum_bd"),
        F.min(F.when(F.col("is_bd"), F.col("d"))).over(w_next).alias("next_bd"))


def date_bounds(df: DataFrame, *date_cols: str) -> DataFrame:
    mins = [F.min(c) for c in date_cols]
    maxs = [F.max(c) for c in date_cols]
    lo = F.least(*mins) if len(mins) > 1 else mins[0]
    hi = F.greatest(*maxs) if len(maxs) > 1 else maxs[0]
    return df.agg(lo.alias("lo"), hi.alias("hi"))


def joint_bounds(*bounds: DataFrame) -> DataFrame:
    """One row that spans the one-row bounds given."""
    out = bounds[0]
    for b in bounds[1:]:
        out = out.union(b)
    return out.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def business_days_between(df: DataFrame, start_col: str, end_col: str, holidays: DataFrame,
                          out_col: str = "business_days", bounds: DataFrame | None = None) -> DataFrame:
    """Weekdays that are not holidays between two dates, both ends counted, order-free.
    ``bounds`` (one row: lo, hi) spares a pass over ``df`` where the span is known from its
    sources."""
    span = bounds if bounds is not None else date_bounds(df, start_col, end_col)
    cal = F.broadcast(reliable_checkpoint(build_calendar(span, holidays)))
    lo = F.least(start_col, end_col)
    hi = F.greatest(start_col, end_col)
    tmp = df.withColumns({"__lo": lo, "__hi": hi})
    a = cal.select(F.col("d").alias("__lo"), F.col("cum_bd").alias("__cum_lo"),
                   F.col("is_bd").alias("__bd_lo"))
    b = cal.select(F.col("d").alias("__hi"), F.col("cum_bd").alias("__cum_hi"))
    out = tmp.join(a, "__lo", "left").join(b, "__hi", "left")
    n = F.col("__cum_hi") - F.col("__cum_lo") + F.col("__bd_lo").cast("int")
    return out.withColumn(out_col, n).drop("__lo", "__hi", "__cum_lo", "__bd_lo", "__cum_hi")


def next_business_day(df: DataFrame, date_col: str, holidays: DataFrame) -> DataFrame:
    """Adds ``is_business_day`` and ``next_business_day`` (first business day after the date)."""
    cal = F.broadcast(reliable_checkpoint(build_calendar(date_bounds(df, date_col), holidays)))
    look = cal.select(F.col("d").alias(date_col), F.col("is_bd").alias("is_business_day"),
                      F.col("next_bd").alias("next_business_day"))
    return df.join(look, date_col, "left")

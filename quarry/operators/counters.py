"""Counters and cumulative histograms over sliding windows.

Both are computed from one row per minute (and series), which is summed within the tasks first and
fanned out to the windows that hold the minute; rows of a series are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.metrics import fan_minutes, minute_of, minute_windows

# Upper bounds of latency buckets, in seconds; the last bucket has none.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram_value(counts: list[Column], bounds: tuple[float, ...], q: float) -> Column:
    """The ``q`` quantile of a histogram whose bucket k, of ``counts[k]`` cumulative values, ends at
    ``bounds[k]``; the last of ``counts`` is the bucket without an end, so the total. The rank
    ``q * total`` is found in the first bucket that reaches it and interpolated between its ends;
    the first bucket begins at 0 (a bound that is not positive stands for itself). In the bucket without
    an end the greatest bound is the answer. Null without values, and where the bucket is empty."""
    total = counts[-1]
    rank = F.lit(float(q)) * total
    value = F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        low, before = (bounds[k - 1], counts[k - 1]) if k else (0.0, F.lit(0))
        inside = F.lit(float(low)) + F.lit(float(bounds[k] - low)) * F.try_divide(rank - before, (counts[k] - before).cast("double"))
        if not k and bounds[0] <= 0:
            inside = F.lit(float(bounds[0]))
        value = F.when(counts[k] >= rank, inside).otherwise(value)
    return F.when(total > 0, value)


def histogram_quantiles(requests: DataFrame, quantiles: dict[str, float], value_col: str = "duration_s",
                        bounds: tuple[float, ...] = LATENCY_BOUNDS, keys: list[str] | None = None) -> DataFrame:
    """Quantiles per sliding window, as read from cumulative buckets with fixed ``bounds``: one row of
    bucket counts per minute (and ``keys``), which add up over minutes, tasks and runs. Values that
    are null or NaN are in no bucket; a window without values gives null."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    names = [f"__le{k}" for k in range(len(bounds) + 1)]
    per_minute = [F.count_if(v <= float(b)).alias(n) for n, b in zip(names, bounds)] + [F.count(v).alias(names[-1])]
    windows = minute_windows(requests, per_minute, [F.sum(n).alias(n) for n in names], keys)
    counts = [F.col(n) for n in names]
    return windows.select("window_start", "window_end", *(keys or []), counts[-1].alias("requests"),
                          *[histogram_value(counts, bounds, q).alias(name) for name, q in quantiles.items()])


def counter_rate(samples: DataFrame, series: str, value_col: str = "value", ts_col: str = "ts", minutes: int = 5) -> DataFrame:
    """``(window_start, window_end, series, samples, increase, rate_per_s)`` of counters that grow and may
    restart at 0, per sliding window of ``minutes``.

    The increase adds up the steps between samples in a row; a sample below the one before it is a
    restart and counts whole. It is then carried on to the window's ends by its mean step time: to the
    end itself when that is at most 1.1 mean steps away, else half a step, and at the front never
    to before the counter would have been 0. A window with less than two samples has no row. Samples
    at one time are taken in order of value; those without a time, a value or a series are left out.

    Steps are taken within each minute first; a series then has one row per minute, of which
    windows are made.
    """
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    clean = samples.select(F.col(series).alias("series"), minute_of(ts_col).alias("__m"), us.alias("__us"), F.col(value_col).cast("double").alias("__v")).filter(
        "series is not null and __us is not null and __v is not null and not isnan(__v)")
    order = Window.partitionBy("series", "__m").orderBy("__us", "__v")
    before = F.lag("__v").over(order)
    step = F.when(before.isNull(), 0.0).when(F.col("__v") >= before, F.col("__v") - before).otherwise(F.col("__v"))
    at = F.struct("__us", "__v")
    per = clean.withColumn("__step", step).groupBy("series", "__m").agg(
        F.min(at).alias("__first"), F.max(at).alias("__last"), F.sum("__step").alias("__inside"), F.count(F.lit(1)).alias("__n"))
    line = Window.partitionBy("series").orderBy("__m")  # one row per minute
    last = F.lag("__last").over(line)
    first = F.col("__first.__v")
    linked = per.withColumn("__from", F.lag("__m").over(line)).withColumn(
        "__between", F.when(first >= last["__v"], first - last["__v"]).otherwise(first))
    fanned = fan_minutes(linked, minutes)
    inside = F.col("__from").cast("timestamp_ntz") >= F.col("window_start")  # the minute before is in the window too
    w = fanned.groupBy("window_start", "window_end", "series").agg(
        F.sum("__n").alias("samples"), F.min("__first").alias("f"), F.max("__last").alias("l"),
        (F.sum("__inside") + F.sum(F.when(inside, F.col("__between")).otherwise(0.0))).alias("raw"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = w.filter((F.col("samples") > 1) & (F.col("l.__us") > F.col("f.__us"))).withColumn("span", (F.col("l.__us") - F.col("f.__us")) / 1e6)
    mean = F.col("span") / (F.col("samples") - 1)
    front, back = (F.col("f.__us") - seconds("window_start")) / 1e6, (seconds("window_end") - F.col("l.__us")) / 1e6
    reach = lambda gap: F.when(gap >= mean * 1.1, mean / 2).otherwise(gap)
    zero = F.when((F.col("raw") > 0) & (F.col("f.__v") >= 0), F.col("span") * (F.col("f.__v") / F.col("raw")))
    carried = F.col("span") + F.least(reach(front), F.coalesce(zero, reach(front))) + reach(back)
    increase = F.col("raw") * (carried / F.col("span"))
    return w.select("window_start", "window_end", F.col("series").alias(series), "samples", increase.alias("increase"),
                    (increase / F.lit(60.0 * minutes)).alias("rate_per_s"))


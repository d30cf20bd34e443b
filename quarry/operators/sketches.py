"""Approximate metrics over sliding windows from mergeable sketches: one sketch per minute, of bounded
size whatever the minute holds, merged for each window. What moves is one sketch per task and
minute, where the exact keys move a row per user or read the values a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.metrics import minute_of, minute_windows

HLL_BITS = 12   # 2 ** 12 registers: relative standard error 1.04 / 64
KLL_K = 400     # rank error of about 0.7 % at 99 % confidence
WINDOW = ["window_start", "window_end"]


def user_hash(user_col: str):
    """Users of any type as a long; rows without a user count as one user."""
    return F.xxhash64(F.col(user_col))


def approx_active_users(requests: DataFrame, user_col: str = "user_id", bits: int = HLL_BITS) -> DataFrame:
    """``(window_start, window_end, active_users)``: distinct users per 5-minute window sliding by one
    minute, from a HyperLogLog sketch per minute. Rows without a user are one user, rows without a
    time are in no window; an empty table gives no windows."""
    timed = requests.filter("ts is not null")
    return minute_windows(timed, [F.hll_sketch_agg(user_hash(user_col), bits).alias("s")],
                          [F.hll_sketch_estimate(F.hll_union_agg("s")).alias("active_users")])


def approx_latency(requests: DataFrame, value_col: str = "duration_s", qs: tuple = (0.5, 0.95), k: int = KLL_K) -> DataFrame:
    """``(window_start, window_end, n, q50, q95, …)``: quantiles of the values of the same windows, from a
    KLL sketch per minute. Null values and rows without a time take no part; minutes without a
    value have no sketch."""
    timed = requests.filter(F.col("ts").isNotNull() & F.col(value_col).isNotNull()).withColumn("__v", F.col(value_col).cast("double"))
    merged = minute_windows(timed, [F.kll_sketch_agg_double("__v", k).alias("s")], [F.kll_merge_agg_double("s").alias("s")])
    return merged.select(*WINDOW, F.kll_sketch_get_n_double("s").alias("n"),
                         *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{round(100 * q)}") for q in qs])


def true_ranks(requests: DataFrame, sketched: DataFrame, value_col: str = "duration_s", qs: tuple = (0.5, 0.95)) -> DataFrame:
    """``(window_start, window_end, low50, high50, …)``: the share of a window's values below each
    estimate of ``sketched``, and the share not above it. The estimates, one row per window, are
    fanned out to their five minutes; the values are read once."""
    names = [f"q{round(100 * q)}" for q in qs]
    minutes = sketched.withColumn("__m", F.explode(F.sequence(
        F.col("window_start").cast("timestamp"), F.col("window_end").cast("timestamp") - F.expr("INTERVAL 1 MINUTE"), F.expr("INTERVAL 1 MINUTE"))))
    rows = requests.filter(F.col("ts").isNotNull() & F.col(value_col).isNotNull()).select(
        minute_of().alias("__m"), F.col(value_col).cast("double").alias("__v"))
    values = rows.groupBy("__m", "__v").agg(F.count(F.lit(1)).alias("__c"))
    share = lambda kept: F.sum(F.when(kept, F.col("__c")).otherwise(0)) / F.sum("__c")
    return values.join(minutes, "__m").groupBy(*WINDOW).agg(*[x for q in names for x in (
        share(F.col("__v") < F.col(q)).alias("low" + q[1:]), share(F.col("__v") <= F.col(q)).alias("high" + q[1:]))])


def stream_active_users(events: DataFrame, user_col: str = "user_id", delay: str = "10 minutes", bits: int = HLL_BITS) -> DataFrame:
    """``approx_active_users`` of a stream: the state is one sketch per open window, however many users
    it holds. A window is emitted when the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    found = timed.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(user_hash(user_col), bits)).alias("active_users"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "active_users")

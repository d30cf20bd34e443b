"""Request metrics over time windows, threshold alerts, "held for" alert firing, liveness gaps,
sliding per-user request counts and the sequential rate-limit admission.

Decomposable metrics are computed from per-minute pre-aggregates; exact quantiles use the
distributed selection of ``quantiles.exact_quantiles``.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.quantiles import exact_quantiles
from quarry.session import reliable_checkpoint


def with_event_time(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Event time as a session-zone timestamp (the files hold timestamp without zone)."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def minute_of(ts_col: str = "ts"):
    return F.date_trunc("minute", F.col(ts_col).cast("timestamp"))


def fan_minutes(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Rows of a minute (column ``__m``) once for each sliding window that holds it."""
    fan = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))).alias("__k"))
    start = F.col("__m") - F.make_interval(mins=F.col("__k"))
    return fan.withColumn("window_start", start.cast("timestamp_ntz")).withColumn(
        "window_end", (start + F.expr(f"INTERVAL {minutes} MINUTES")).cast("timestamp_ntz")).drop("__k")


def minute_windows(df: DataFrame, per_minute: list, per_window: list, keys: list[str] | None = None,
                   ts_col: str = "ts", minutes: int = 5) -> DataFrame:
    """Sliding ``minutes``-long windows advancing by one minute, computed from a per-minute
    pre-aggregate: the raw rows are reduced to one row per minute (map-side partial
    aggregation), and only those rows are fanned out to the windows that contain them."""
    keys = keys or []
    pm = df.groupBy(minute_of(ts_col).alias("__m"), *keys).agg(*per_minute)
    return fan_minutes(pm, minutes).groupBy("window_start", "window_end", *keys).agg(*per_window)


def request_rate(requests: DataFrame, seconds: int = 300) -> DataFrame:
    return (minute_windows(requests, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("requests")])
            .withColumn("rate_per_s", (F.col("requests") / F.lit(float(seconds)))))


def error_ratio(requests: DataFrame) -> DataFrame:
    return (minute_windows(
        requests,
        [F.count_if(F.col("status").between(500, 599)).alias("e"), F.count(F.lit(1)).alias("n")],
        [F.sum("e").alias("errors"), F.sum("n").alias("requests")])
        .withColumn("error_ratio", (F.col("errors") / F.col("requests"))))


def active_users(requests: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Distinct users per 5-minute sliding window, exact: rows are first reduced to distinct
    (minute, user) pairs, which are fanned out to their windows and counted."""
    pairs = minute_windows(requests, [F.count(F.lit(1)).alias("n")], [F.count(F.lit(1)).alias("x")],
                           keys=[user_col])
    return pairs.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("active_users"))


def mean_latency(requests: DataFrame, value_col: str = "duration_s") -> DataFrame:
    return (minute_windows(requests, [F.sum(value_col).alias("s"), F.count(value_col).alias("c")],
                           [F.sum("s").alias("s"), F.sum("c").alias("c")])
            .select("window_start", "window_end", (F.col("s") / F.col("c")).alias("mean_latency_s")))


def latency_quantiles(requests: DataFrame, value_col: str = "duration_s") -> DataFrame:
    """p50 and p95 per sliding window, from counts per minute and value bucket."""
    by_minute = requests.select(minute_of().alias("__m"), value_col)
    q = exact_quantiles(by_minute, ["window_start", "window_end"], value_col, {"p50_latency_s": 0.5, "p95_latency_s": 0.95},
                        keys=["__m"], fan=fan_minutes)
    return q.withColumns({c: F.col(c) for c in ("p50_latency_s", "p95_latency_s")})


# Alert rules (metric, comparison, limit).
ALERT_RULES = [
    ("error_ratio", ">", 0.05),
    ("p95_latency_s", ">", 2.0),
    ("mean_latency_s", ">", 5.0),
    ("memory_gb", ">", 8.0),
    ("free_disk_ratio", "<", 0.10),
]


def metric_table(requests: DataFrame, memory_bytes: str, free_bytes: str, size_bytes: str) -> DataFrame:
    """Tall (window_start, metric, value) table of the alerting metrics per sliding window. Gauges
    are the latest reading in the window: resident memory, in GB, and the free share of the disk;
    the three arguments name their columns."""
    latest = F.struct(F.col("ts"), F.col("request_id"), F.col(memory_bytes).alias("memory"),
                      F.try_divide(F.col(free_bytes), F.col(size_bytes)).alias("free"))
    base = minute_windows(
        requests,
        [F.count_if(F.col("status").between(500, 599)).alias("e"), F.count(F.lit(1)).alias("n"),
         F.sum("duration_s").alias("s"), F.count("duration_s").alias("c"), F.max(latest).alias("last")],
        [(F.sum("e") / F.sum("n")).alias("error_ratio"), (F.sum("s") / F.sum("c")).alias("mean_latency_s"),
         F.max("last").alias("last")]).select(
        "window_start", "error_ratio", "mean_latency_s", (F.col("last.memory") / (1 << 30)).alias("memory_gb"),
        F.col("last.free").alias("free_disk_ratio"))
    q = exact_quantiles(requests.select(minute_of().alias("__m"), "duration_s"), ["window_start"], "duration_s",
                        {"p95_latency_s": 0.95}, keys=["__m"], fan=fan_minutes)
    wide = base.join(q, "window_start")
    return wide.select("window_start", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in ["error_ratio", "mean_latency_s", "memory_gb", "free_disk_ratio", "p95_latency_s"]])).alias("m")
    ).select("window_start", "m.metric", F.col("m.value").alias("value"))


def alert_breaches(metrics: DataFrame) -> DataFrame:
    spark = metrics.sparkSession
    # the rule table is the fixed list above: its size is known without counting
    rules = F.broadcast(spark.createDataFrame(ALERT_RULES, "metric string, op string, limit double"))
    j = metrics.join(rules, "metric")
    breach = F.when(F.col("op") == ">", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return j.filter(breach).select("window_start", "metric", "value", "limit")


def alert_firing(breaches: DataFrame, step_minutes: int = 1, hold_minutes: int = 5) -> DataFrame:
    """Windows at which a breach has held continuously for ``hold_minutes`` (gaps and
    islands on the minute index; a missing window ends the run). The window per metric
    orders one row per minute of breach, so its size is bounded by the time span."""
    idx = (F.unix_timestamp(F.col("window_start").cast("timestamp")) / (60 * step_minutes)).cast("long")
    b = breaches.select("metric", "window_start", idx.alias("i"))
    w = Window.partitionBy("metric").orderBy("i")
    islands = b.withColumn("grp", F.col("i") - F.row_number().over(w))
    w2 = Window.partitionBy("metric", "grp")
    runs = islands.withColumn("run_start", F.min("window_start").over(w2)).withColumn(
        "run_first_i", F.min("i").over(w2))
    held = F.col("i") - F.col("run_first_i") >= hold_minutes // step_minutes
    return runs.filter(held).select("metric", "window_start", "run_start")


def liveness_gaps(events: DataFrame, source_col: str, ts_col: str = "ts", bucket_seconds: int = 60,
                  hold: int = 1, end: str | None = None) -> DataFrame:
    """Runs of time buckets in which a source sent nothing, from its first event on to the end of
    all data (or to the time ``end``), so that a source that fell silent for good is reported:
    ``(source, down_from, down_until, buckets, firing)``; ``firing`` tells runs that outlast
    ``hold`` buckets. A source costs one row per bucket in which it is alive."""
    b = (F.unix_timestamp(F.col(ts_col).cast("timestamp")) / bucket_seconds).cast("long")
    seen = events.select(source_col, b.alias("bucket")).filter("bucket is not null").distinct()
    last = F.floor(F.unix_timestamp(F.lit(end).cast("timestamp")) / bucket_seconds) if end else events.agg(F.max(b)).scalar()
    nxt = F.coalesce(F.lead("bucket").over(Window.partitionBy(source_col).orderBy("bucket")), last + 1)
    runs = seen.withColumn("until", nxt).filter(F.col("until") - F.col("bucket") > 1)
    at = lambda c: F.timestamp_seconds(c * bucket_seconds).cast("timestamp_ntz")
    n = F.col("until") - F.col("bucket") - 1
    return runs.select(source_col, at(F.col("bucket") + 1).alias("down_from"), at(F.col("until")).alias("down_until"),
                       n.alias("buckets"), (n > hold).alias("firing"))


def sliding_requests(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests by the same user in the preceding ``seconds`` (inclusive of the row).

    A window partitioned by user alone would put a hot user's whole history into one task.
    The frame only reaches back ``seconds``, so the timeline is cut into buckets of that
    length: each row is a target in its own bucket and a context copy in the next one, and
    the range frame runs per (user, bucket) — every partition holds at most two buckets of
    one user's rows, and the counts are exact.
    """
    span = seconds * 1_000_000
    base = requests.select("request_id", "user_id", "ts",
                           F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"))
    bucket = F.floor(F.col("__us") / F.lit(span)).cast("long")
    tagged = base.select("*", F.explode(F.array(
        F.struct(bucket.alias("b"), F.lit(True).alias("target")),
        F.struct((bucket + 1).alias("b"), F.lit(False).alias("target")))).alias("__t")).select(
        "request_id", "user_id", "ts", "__us", "__t.b", "__t.target")
    w = Window.partitionBy("user_id", "b").orderBy("__us").rangeBetween(-span, 0)
    counted = tagged.withColumn("requests_60s", F.count(F.lit(1)).over(w))
    return counted.filter("target").select("request_id", "user_id", "ts", "requests_60s")


# Requests per 60 s by role; unknown roles get the "user" limit.
ROLE_LIMITS = {"anonymous": 10, "user": 100, "premium": 500, "admin": 1000}
DEFAULT_ROLE = "user"
WINDOW_SECONDS = 60


def role_limit(role_col: str = "role", limits: dict | None = None):
    limits = limits or ROLE_LIMITS
    m = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.col(role_col)), F.lit(limits[DEFAULT_ROLE]))


def decide_admissions(window: deque, t: np.ndarray, lim: np.ndarray) -> np.ndarray:
    """Admit requests at times ``t`` (ascending) one after another against ``window``, the
    admitted times of the last ``WINDOW_SECONDS`` (updated in place); rejected requests do
    not count. Fast path: when even counting every request (admitted or not) no row's window
    reaches its limit, all are admitted — two binary searches instead of the per-row loop."""
    n = len(t)
    if n == 0:
        return np.zeros(0, dtype=bool)
    prev = np.fromiter(window, dtype=np.float64, count=len(window))
    lo = t - WINDOW_SECONDS
    in_prev = len(prev) - np.searchsorted(prev, lo, side="left")
    in_batch = np.arange(n) - np.searchsorted(t, lo, side="left") + 1
    if np.all(in_prev + in_batch <= lim):
        window.extend(t.tolist())
        while window and window[0] < t[-1] - WINDOW_SECONDS:
            window.popleft()
        return np.ones(n, dtype=bool)
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        now = t[i]
        while window and window[0] < now - WINDOW_SECONDS:
            window.popleft()
        if len(window) < lim[i]:
            window.append(now)
            out[i] = True
    return out


ADMITTED = "request_id long, user_id long, role string, us long, admitted boolean"


def _admit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential admission, run by run. Rows arrive in Arrow batches, ordered by run and in it by
    (ts, request_id); a run may go on in the next batch. State is the run at hand and the deque of
    times admitted in its last window (≤ limit entries)."""
    window: deque = deque()
    current = None
    for pdf in batches:
        user, run = pdf["user_id"].to_numpy(), pdf["run"].to_numpy()
        t, lim = pdf["us"].to_numpy() / 1e6, pdf["lim"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (run[1:] != run[:-1])]) if len(t) else []
        out = np.zeros(len(t), dtype=bool)
        for a, b in zip(starts, [*starts[1:], len(t)]):
            if (user[a], run[a]) != current:
                window.clear()
                current = (user[a], run[a])
            out[a:b] = decide_admissions(window, t[a:b], lim[a:b])
        yield pdf[["request_id", "user_id", "role", "us"]].assign(admitted=out)


def admission_runs(cols: DataFrame) -> DataFrame:
    """``(user_id, b, run, binds)`` per non-empty 60-s bucket of a user. An empty bucket between two
    requests lies over the whole window, so a run of neighbouring non-empty buckets depends on
    nothing before it. ``binds`` is false for runs in which no two neighbouring buckets together
    hold more requests than the run's least limit: there every request is admitted."""
    per = cols.groupBy("user_id", "b").agg(F.count(F.lit(1)).alias("n"), F.min("lim").alias("lim"))
    w = Window.partitionBy("user_id").orderBy("b")  # one row per bucket, bounded by the time span
    per = per.withColumn("before", F.lag("b").over(w)).withColumn("n_before", F.lag("n").over(w))
    near = F.col("before") == F.col("b") - 1
    per = per.withColumn("run", F.sum(F.when(near, 0).otherwise(1)).over(w)).withColumn(
        "most", F.col("n") + F.when(near, F.col("n_before")).otherwise(0))
    whole = Window.partitionBy("user_id", "run")
    return per.select("user_id", "b", "run", (F.max("most").over(whole) > F.min("lim").over(whole)).alias("binds"))


NO_USER = -(1 << 63)


def rate_limit_admission(requests: DataFrame, limits: dict | None = None) -> DataFrame:
    """Exact sliding-window admission (rejected requests do not count). Requests without a user
    share one limit as one user; requests without a time are not decided and left out.

    The unit of work is a (user, run of non-empty 60-s buckets), see ``admission_runs``. Runs that
    cannot reach a limit, normally almost all, are admitted in the JVM. The others are spread by
    run, sorted, and decided one request after another as a stream of Arrow batches that keeps the
    ≤ limit admitted times only.
    """
    span = WINDOW_SECONDS * 1_000_000
    cols = requests.filter("ts is not null").select(
        "request_id", F.coalesce(F.col("user_id").cast("long"), F.lit(NO_USER)).alias("user_id"), "role",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        role_limit("role", limits).alias("lim")).withColumn("b", F.floor(F.col("us") / F.lit(span)))
    runs = reliable_checkpoint(admission_runs(cols))
    tagged = cols.join(runs, ["user_id", "b"])
    free = tagged.filter(~F.col("binds")).select("request_id", "user_id", "role", "us", F.lit(True).alias("admitted"))
    bound = tagged.filter("binds").select("request_id", "user_id", "role", "us", "lim", "run").repartition(
        "user_id", "run").sortWithinPartitions("user_id", "run", "us", "request_id")
    decided = free.unionByName(bound.mapInPandas(_admit_batches, ADMITTED))
    return decided.select("request_id", F.nullif("user_id", F.lit(NO_USER)).alias("user_id"),
                          F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "role", "admitted")

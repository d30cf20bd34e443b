"""Metric and alert bindings: I1-I4, I6-I9, F1, F2 over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics as mt
from quarry.plans import fixtures as fx
from quarry.plans.catalog import query

WIN_SQL = fx.cte("requests")[:-1] + """,
win AS (SELECT r.*, CAST(time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS TIMESTAMP) AS window_start,
          CAST(time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) + INTERVAL 5 MINUTE AS TIMESTAMP) AS window_end
        FROM requests r, range(0, 5) t(k))
"""


def requests(spark, sf):
    return fx.table(spark, sf, "requests")


@query("request_rate", WIN_SQL + """SELECT window_start, window_end, count(*) AS requests,
  round(count(*) / 300.0, 6) AS rate_per_s FROM win GROUP BY ALL""")
def q_request_rate(spark, sf):
    return mt.request_rate(requests(spark, sf))


@query("error_ratio", WIN_SQL + """SELECT window_start, window_end,
  CAST(count_if(status BETWEEN 500 AND 599) AS BIGINT) AS errors, count(*) AS requests,
  round(count_if(status BETWEEN 500 AND 599) / count(*), 6) AS error_ratio FROM win GROUP BY ALL""")
def q_error_ratio(spark, sf):
    return mt.error_ratio(requests(spark, sf))


@query("latency_quantiles", WIN_SQL + """SELECT window_start, window_end,
  round(quantile_cont(duration_s, 0.5), 6) AS p50_latency_s,
  round(quantile_cont(duration_s, 0.95), 6) AS p95_latency_s FROM win GROUP BY ALL""")
def q_latency_quantiles(spark, sf):
    return mt.latency_quantiles(requests(spark, sf))


@query("active_users_5m", WIN_SQL + """SELECT window_start, window_end,
  count(DISTINCT user_id) AS active_users FROM win GROUP BY ALL""")
def q_active_users(spark, sf):
    return mt.active_users(requests(spark, sf))


@query("mean_latency", WIN_SQL + """SELECT window_start, window_end,
  round(avg(duration_s), 6) AS mean_latency_s FROM win GROUP BY ALL""")
def q_mean_latency(spark, sf):
    return mt.mean_latency(requests(spark, sf))


# Gauges that the request log does not have stand in by expressions over it.
GAUGES = {"memory_bytes": "duration_s * 8 * 1073741824", "disk_free": "CAST(request_id % 97 AS double) * 1000", "disk_size": "CAST(97000 AS double)"}

METRICS_SQL = WIN_SQL.replace("SELECT r.*,", "SELECT r.*, " + ", ".join(f"{v} AS {k}" for k, v in GAUGES.items()) + ",")[:-1] + """,
wide AS (SELECT window_start,
    count_if(status BETWEEN 500 AND 599) / count(*) AS error_ratio, avg(duration_s) AS mean_latency_s,
    arg_max(memory_bytes, (ts, request_id)) / 1073741824 AS memory_gb,
    arg_max(disk_free / disk_size, (ts, request_id)) AS free_disk_ratio, quantile_cont(duration_s, 0.95) AS p95_latency_s
  FROM win GROUP BY window_start),
tall AS (SELECT window_start, 'error_ratio' AS metric, round(error_ratio, 6) AS value FROM wide
  UNION ALL SELECT window_start, 'mean_latency_s', round(mean_latency_s, 6) FROM wide
  UNION ALL SELECT window_start, 'memory_gb', round(memory_gb, 6) FROM wide
  UNION ALL SELECT window_start, 'free_disk_ratio', round(free_disk_ratio, 6) FROM wide
  UNION ALL SELECT window_start, 'p95_latency_s', round(p95_latency_s, 6) FROM wide),
rules AS (SELECT * FROM (VALUES ('error_ratio', '>', 0.05), ('p95_latency_s', '>', 2.0),
  ('mean_latency_s', '>', 5.0), ('memory_gb', '>', 8.0), ('free_disk_ratio', '<', 0.10)) t(metric, op, lim)),
breaches AS (SELECT t.window_start, t.metric, t.value, CAST(r.lim AS DOUBLE) AS "limit"
  FROM tall t JOIN rules r ON t.metric = r.metric
  WHERE CASE WHEN r.op = '>' THEN t.value > r.lim ELSE t.value < r.lim END)
"""


def breaches_df(spark, sf):
    log = requests(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in GAUGES.items()])
    return mt.alert_breaches(mt.metric_table(log, "memory_bytes", "disk_free", "disk_size"))


@query("alert_breaches", METRICS_SQL + "SELECT * FROM breaches")
def q_alert_breaches(spark, sf):
    return breaches_df(spark, sf)


@query("alert_firing", METRICS_SQL + """, idx AS (SELECT metric, window_start,
    CAST(epoch(window_start) / 60 AS BIGINT) AS i FROM breaches),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY metric ORDER BY i) AS grp FROM idx),
runs AS (SELECT *, min(window_start) OVER (PARTITION BY metric, grp) AS run_start,
         min(i) OVER (PARTITION BY metric, grp) AS first_i FROM isl)
SELECT metric, window_start, run_start FROM runs WHERE i - first_i >= 5""")
def q_alert_firing(spark, sf):
    return mt.alert_firing(breaches_df(spark, sf))


# purchases stop half-way through the data, for good
QUIET = "event_type <> 'purchase' OR ts < TIMESTAMP '2024-01-15 00:00:00'"


@query("liveness_gaps", f"""WITH alive AS (SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS bucket FROM events WHERE {QUIET}),
seen AS (SELECT DISTINCT * FROM alive),
runs AS (SELECT event_type, bucket, coalesce(lead(bucket) OVER (PARTITION BY event_type ORDER BY bucket),
  (SELECT max(bucket) + 1 FROM alive)) AS until FROM seen)
SELECT event_type, CAST(to_timestamp((bucket + 1) * 60) AS TIMESTAMP) AS down_from,
  CAST(to_timestamp(until * 60) AS TIMESTAMP) AS down_until, until - bucket - 1 AS buckets, until - bucket - 1 > 1 AS firing
FROM runs WHERE until - bucket > 1""")
def q_liveness(spark, sf):
    return mt.liveness_gaps(fx.table(spark, sf, "events").filter(QUIET), "event_type")


@query("sliding_requests", fx.cte("requests") + """SELECT request_id, user_id, ts,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)
    AS requests_60s
FROM requests""")
def q_sliding_requests(spark, sf):
    return mt.sliding_requests(requests(spark, sf))


# The log's requests within two hours and under limits that bind.
BUSY_LIMITS = {"anonymous": 1, "user": 1, "premium": 2, "admin": 3}
BUSY_SQL = fx.cte("requests")[:-1] + """,
busy AS (SELECT request_id, user_id, role, make_timestamp(1704067200000000 + epoch_us(ts) % 7200000000) AS ts,
  CASE role WHEN 'anonymous' THEN 1 WHEN 'premium' THEN 2 WHEN 'admin' THEN 3 ELSE 1 END AS lim,
  epoch_us(ts) % 7200000000 AS us FROM requests),
turns AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, request_id) AS turn FROM busy),
walk(user_id, turn, request_id, times, admitted) AS (
  SELECT user_id, turn, request_id, CASE WHEN lim > 0 THEN [us] ELSE CAST([] AS BIGINT[]) END, lim > 0 FROM turns WHERE turn = 1
  UNION ALL
  SELECT t.user_id, t.turn, t.request_id,
    CASE WHEN len(list_filter(w.times, lambda x: x >= t.us - 60000000)) < t.lim
         THEN list_append(list_filter(w.times, lambda x: x >= t.us - 60000000), t.us)
         ELSE list_filter(w.times, lambda x: x >= t.us - 60000000) END,
    len(list_filter(w.times, lambda x: x >= t.us - 60000000)) < t.lim
  FROM walk w JOIN turns t ON t.user_id = w.user_id AND t.turn = w.turn + 1)
"""
BUSY_SQL = BUSY_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def busy_requests(spark, sf):
    us = F.lit(1_704_067_200_000_000) + F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(7_200_000_000))
    return requests(spark, sf).withColumn("ts", F.timestamp_micros(us).cast("timestamp_ntz"))


@query("rate_limit_admission", BUSY_SQL + """SELECT request_id, user_id, busy.ts, busy.role, walk.admitted
FROM walk JOIN busy USING (request_id, user_id)""")
def q_rate_limit(spark, sf):
    return mt.rate_limit_admission(busy_requests(spark, sf), limits=BUSY_LIMITS)

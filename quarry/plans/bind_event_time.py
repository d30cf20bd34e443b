"""Event-time bindings over the event table and the request log (§2.I): sessions, replay
protection, late rows, alerts by timers, bucket quantiles and counter rates. Streams are replays of
files of consecutive time ranges, as in ``bind_streams``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import counters as ct
from quarry.operators import metrics as mt
from quarry.operators import sketches as sketch
from quarry.plans import fixtures as fx
from quarry.plans.bind_metrics import BUSY_SQL, GAUGES, METRICS_SQL, QUIET, WIN_SQL, busy_requests, requests
from quarry.plans.bind_streams import CLOSING_TS, land_in_time_order
from quarry.plans.catalog import query
from quarry.session import scratch_path
from quarry.sources import sinks as sk
from quarry.streaming import event_time as et
from quarry.streaming import streams as st

SESSIONS_SQL = """WITH steps AS (SELECT user_id, ts, value,
  CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM steps)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events, round(sum(value), 6) AS value_sum
FROM numbered GROUP BY user_id, s"""


@query("user_sessions", SESSIONS_SQL)
def q_user_sessions(spark, sf):
    return et.user_sessions(fx.table(spark, sf, "events"))


def replay(spark, sf, df, closing):
    path, schema, files = land_in_time_order(df, closing)
    return st.file_stream(spark, path, schema, max_files_per_trigger=files), schema


@query("stream_sessions", SESSIONS_SQL)
def q_stream_sessions(spark, sf):
    stream, _ = replay(spark, sf, fx.table(spark, sf, "events"), {"ts": CLOSING_TS, "user_id": "-1"})
    out = st.run_to_sink(et.stream_sessions(stream), "sessions")
    return spark.read.parquet(out).filter("user_id >= 0")


def sent_twice(events):
    """Every tenth event is sent again, every other one of these six hours of event time later, at
    which time it then stands between others (``sent``, the order of sending)."""
    times = F.when(F.col("event_id") % 10 != 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.when(F.col("event_id") % 20 == 0, 6).otherwise(0)))
    return events.withColumn("h", F.explode(times)).withColumn("sent", F.col("ts") + F.make_dt_interval(hours=F.col("h"))).drop("h")


@query("stream_replay", "SELECT * FROM events")
def q_stream_replay(spark, sf):
    events = fx.table(spark, sf, "events")
    landed = sent_twice(events).withColumnsRenamed({"ts": "event_ts", "sent": "ts"})
    stream, _ = replay(spark, sf, landed, {"ts": CLOSING_TS, "event_id": "-1"})
    once = et.drop_replays(stream.drop("ts").withColumnRenamed("event_ts", "ts"), "event_id", "1 day")
    out = st.run_to_sink(once.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*events.columns), "replay")
    return spark.read.parquet(out).filter("event_id >= 0")


# every twentieth event is delivered three days late
DELIVERED = "CAST(ts AS DATE) + CASE WHEN event_id % 20 = 3 THEN 3 ELSE 0 END"


@query("stream_late_rows", f"""WITH sent AS (SELECT event_id, ts, {DELIVERED} AS day FROM events),
days AS (SELECT day, max(ts) AS last FROM sent GROUP BY day),
marks AS (SELECT day, max(last) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM days)
SELECT event_id, coalesce(ts < seen - INTERVAL 1 DAY, false) AS late FROM sent JOIN marks USING (day)""")
def q_stream_late_rows(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "ts")
    path = scratch_path(spark, "landing-delivered")
    days = events.withColumn("day", F.expr(DELIVERED.replace("CAST(ts AS DATE) + ", "date_add(CAST(ts AS DATE), ") + ")"))
    sk.write_landing(days.repartitionByRange(62, "day").sortWithinPartitions("day"), path)
    st.files_in_order(spark, path)
    stream = st.file_stream(spark, path, days.schema, max_files_per_trigger=1)
    split = et.split_late(stream.drop("day"), "late", 86_400)
    return split.rows(events.schema).select("event_id", "late")


STREAMED = "metric <> 'p95_latency_s'"  # exact quantiles are not streamed


@query("stream_alerts", METRICS_SQL + f""", idx AS (SELECT metric, window_start,
    CAST(epoch(window_start) / 60 AS BIGINT) AS i FROM breaches WHERE {STREAMED}),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY metric ORDER BY i) AS grp FROM idx),
runs AS (SELECT *, min(window_start) OVER (PARTITION BY metric, grp) AS run_start,
         min(i) OVER (PARTITION BY metric, grp) AS first_i FROM isl)
SELECT metric, window_start, run_start FROM runs WHERE i - first_i >= 5""")
def q_stream_alerts(spark, sf):
    log = requests(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in GAUGES.items()])
    stream, _ = replay(spark, sf, log, {"ts": CLOSING_TS, "request_id": "-1", "status": "200", "duration_s": "0", "memory_bytes": "0",
                                        "disk_free": "1", "disk_size": "1"})
    out = st.run_to_sink(et.stream_alerts(et.stream_breaches(stream, "memory_bytes", "disk_free", "disk_size")), "alerts")
    return spark.read.parquet(out)


# the closing row's time less the delay of ten minutes: the end of the last minute with an event
END_OF_LAST = "date_trunc('minute', ts) + INTERVAL 1 MINUTE + INTERVAL 601 SECONDS"


@query("stream_silence", f"""WITH alive AS (SELECT event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) AS bucket FROM events WHERE {QUIET}),
seen AS (SELECT DISTINCT * FROM alive),
runs AS (SELECT event_type, bucket, coalesce(lead(bucket) OVER (PARTITION BY event_type ORDER BY bucket),
  (SELECT max(bucket) + 1 FROM alive)) AS until FROM seen)
SELECT event_type, CAST(to_timestamp((bucket + 1) * 60) AS TIMESTAMP) AS down_from FROM runs WHERE until - bucket - 1 > 1""")
def q_stream_silence(spark, sf):
    stream, _ = replay(spark, sf, fx.table(spark, sf, "events").filter(QUIET), {"ts": END_OF_LAST, "event_type": "'closing'"})
    out = st.run_to_sink(et.stream_silence(stream, "event_type"), "silence")
    return spark.read.parquet(out).filter("event_type <> 'closing'")


_LE = ", ".join(f"count_if(duration_s <= {b}) AS c{k}" for k, b in enumerate(ct.LATENCY_BOUNDS))


def _bucket_sql(q: float) -> str:
    """The definition, bucket by bucket."""
    bounds, cases = ct.LATENCY_BOUNDS, []
    for k, b in enumerate(bounds):
        low, before = (bounds[k - 1], f"c{k - 1}") if k else (0.0, "0")
        cases.append(f"WHEN c{k} >= {q} * n THEN {low} + {b - low} * (({q} * n - {before}) / nullif(c{k} - {before}, 0))")
    return f"CASE WHEN n = 0 THEN NULL {' '.join(cases)} ELSE {bounds[-1]} END"


@query("histogram_quantiles", WIN_SQL[:-1] + f""", h AS (SELECT window_start, window_end, {_LE}, count(duration_s) AS n FROM win GROUP BY ALL)
SELECT window_start, window_end, n AS requests, round({_bucket_sql(0.5)}, 6) AS p50_latency_s, round({_bucket_sql(0.95)}, 6) AS p95_latency_s FROM h""")
def q_histogram_quantiles(spark, sf):
    return ct.histogram_quantiles(requests(spark, sf), {"p50_latency_s": 0.5, "p95_latency_s": 0.95})


# A counter of requests by role, in the busy log, that restarts at every 40th request of its series.
SAMPLES_SQL = BUSY_SQL.replace("turns AS (", """samples AS (SELECT role, ts, epoch_us(ts) AS us, CAST(row_number() OVER (PARTITION BY role ORDER BY us, request_id) % 40 AS double) AS value FROM busy),
turns AS (""")
RATE_SQL = """,
fanned AS (SELECT role, us, value, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS ws FROM samples, range(0, 5) t(k)),
steps AS (SELECT *, lag(value) OVER (PARTITION BY role, ws ORDER BY us, value) AS before FROM fanned),
per AS (SELECT role, ws, count(*) AS n, sum(CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END) AS raw,
  min(us) AS f_us, max(us) AS l_us, arg_min(value, (us, value)) AS f, (max(us) - min(us)) / 1e6 AS span FROM steps GROUP BY role, ws),
ends AS (SELECT *, span / (n - 1) AS mean, (f_us - epoch_us(ws)) / 1e6 AS front, (epoch_us(ws) + 300000000 - l_us) / 1e6 AS back FROM per WHERE n > 1 AND l_us > f_us),
near AS (SELECT *, CASE WHEN front >= 1.1 * mean THEN mean / 2 ELSE front END AS fr, CASE WHEN back >= 1.1 * mean THEN mean / 2 ELSE back END AS ba FROM ends),
out AS (SELECT *, raw * (span + CASE WHEN raw > 0 AND f >= 0 THEN least(fr, span * f / raw) ELSE fr END + ba) / span AS increase FROM near)
SELECT CAST(ws AS TIMESTAMP) AS window_start, CAST(ws + INTERVAL 5 MINUTE AS TIMESTAMP) AS window_end, role, n AS samples,
  round(increase, 6) AS increase, round(increase / 300, 6) AS rate_per_s FROM out"""


def counter_samples(spark, sf):
    """The counter of ``SAMPLES_SQL``, without gathering a role: requests are numbered in a minute and
    minutes are counted up."""
    busy = busy_requests(spark, sf).withColumn("m", F.date_trunc("minute", "ts"))
    per = busy.groupBy("role", "m").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("role").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = busy.join(per.withColumn("before", before), ["role", "m"])
    number = F.row_number().over(Window.partitionBy("role", "m").orderBy("ts", "request_id")) + F.col("before")
    return placed.select("role", "ts", (number % 40).cast("double").alias("value"))


@query("counter_rate", SAMPLES_SQL.rstrip() + RATE_SQL)
def q_counter_rate(spark, sf):
    return ct.counter_rate(counter_samples(spark, sf), "role")


# --- sketches: the estimates themselves are no fixed values, so the keys give the exact result and
# whether the estimate is as near to it as the sketch promises ---------------------------------------

USERS_BOUND = 0.08   # five standard errors of 2 ** 12 registers
RANK_BOUND = 0.02    # of a rank; three times the error of the merged sketches at 99 %


@query("active_users_sketch", WIN_SQL + """SELECT window_start, window_end,
  count(DISTINCT user_id) AS active_users, TRUE AS near FROM win GROUP BY ALL""")
def q_active_users_sketch(spark, sf):
    rows = requests(spark, sf)
    about = sketch.approx_active_users(rows).withColumnRenamed("active_users", "about")
    near = F.abs(F.col("about") - F.col("active_users")) <= F.lit(USERS_BOUND) * F.col("active_users")
    return mt.active_users(rows).join(about, ["window_start", "window_end"], "left").select(
        "window_start", "window_end", "active_users", F.coalesce(near, F.lit(False)).alias("near"))


@query("latency_sketch", WIN_SQL + """SELECT window_start, window_end, count(duration_s) AS n, TRUE AS near50, TRUE AS near95
FROM win GROUP BY ALL HAVING count(duration_s) > 0""")
def q_latency_sketch(spark, sf):
    rows = requests(spark, sf)
    about = sketch.approx_latency(rows)
    ranks = sketch.true_ranks(rows, about)
    near = lambda q: (F.col(f"low{q}") <= q / 100 + RANK_BOUND) & (F.col(f"high{q}") >= q / 100 - RANK_BOUND)
    return about.join(ranks, ["window_start", "window_end"]).select(
        "window_start", "window_end", "n", near(50).alias("near50"), near(95).alias("near95"))

"""Streaming bindings: A13-A15, I5, I10. The event table is landed as parquet files in the
shared folder, then replayed as a file stream until no data is left; the stateful replays
read files of consecutive time ranges, in a bounded number of micro-batches, and a closing row moves the
watermark past the last event, so that every row is decided and every window emitted."""

from __future__ import annotations

import math
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import fixtures as fx
from quarry.plans.bind_metrics import BUSY_LIMITS, BUSY_SQL, busy_requests
from quarry.plans.catalog import query
from quarry.session import scratch_path
from quarry.sources import sinks as sk
from quarry.streaming import streams as st


def land_events(spark, sf, view="events", df=None):
    """Land the table as parquet partitioned by day (one write job; a day of many rows is written by
    many tasks)."""
    path = os.path.join(scratch_path(spark, "landing"), view)
    df = df if df is not None else fx.table(spark, sf, view)
    days = df.withColumn("day", F.to_date(F.col("ts").cast("timestamp")))
    sk.write_curated(days, path, ["day"])
    return path, df.schema


ROWS_PER_FILE = 25_000
BATCHES = 8  # of a replay, besides the closing one


def land_in_time_order(df, closing, rows_per_file=ROWS_PER_FILE):
    """Land a table in one job as files of consecutive time ranges, and a closing file: one row long
    after all others (``closing``: its columns, as SQL), which moves the watermark past the
    data, so that a replay decides every row of it. Files get times in the order of their ranges,
    since that is the order a file stream takes them in. Returns the folder, the schema and how many files
    a replay takes per trigger: one, or as many as leave ``BATCHES`` batches. A batch costs a plan and, for
    each part of the state, a task and a commit, however few rows it has, and the state of a key is
    written once per batch; so a larger table has larger batches, whose files are read side by side."""
    spark = df.sparkSession
    path = scratch_path(spark, "landing-ordered")
    n = df.count()
    files = max(2, math.ceil(n / rows_per_file))
    ordered = df.repartitionByRange(files, "ts").sortWithinPartitions("ts")
    sk.write_landing(ordered, path)
    last = df.agg(F.max("ts").alias("ts")).select(*[F.expr(closing.get(c, "NULL")).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    staged = scratch_path(spark, "landing-closing")
    sk.write_landing(last.coalesce(1), staged)  # one row
    st.files_in_order(spark, path, staged)
    return path, df.schema, math.ceil(files / BATCHES)


CLOSING_TS = "ts + INTERVAL 30 DAYS"


@query("stream_ingest", "SELECT * FROM events")
def q_stream_ingest(spark, sf):
    path, schema = land_events(spark, sf)
    stream = st.file_stream(spark, path, schema)
    out = st.run_to_sink(stream.select(*schema.fieldNames()), "ingest")
    return spark.read.parquet(out)


# every fiftieth event carries text that is no JSON, or JSON cut short
BROKEN = "CASE WHEN event_id % 50 = 7 THEN 'not json' WHEN event_id % 50 = 9 THEN '{\"k\": 5' ELSE props END"


@query("stream_decode", f"""SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN json_valid(props) THEN NULL ELSE props END AS _corrupt_record FROM (SELECT event_id, {BROKEN} AS props FROM events)""")
def q_stream_decode(spark, sf):
    path, schema = land_events(spark, sf, df=fx.table(spark, sf, "events").withColumn("props", F.expr(BROKEN)))
    stream = st.file_stream(spark, path, schema)
    decoded = st.decode_json(stream, "props", T.StructType([T.StructField("k", T.LongType())]))
    out = st.run_to_sink(decoded.select("event_id", "k", "_corrupt_record"), "decode")
    return spark.read.parquet(out)


@query("event_encode", fx.cte("requests") + "SELECT CAST(user_id AS VARCHAR) AS key, request_id, user_id, status, role, round(duration_s, 6) AS duration_s FROM requests")
def q_event_encode(spark, sf):
    """Encoded for a message sink and decoded again: the key beside the columns of the value."""
    table = fx.table(spark, sf, "requests")
    sent = sk.encode_events(table, "user_id")
    schema = T.StructType([table.schema[c] for c in ("request_id", "user_id", "status", "role", "duration_s")])
    back = st.decode_json(sent, "value", schema)
    return back.select("key", "request_id", "user_id", "status", "role", F.round("duration_s", 6).alias("duration_s"))


@query("stream_tumbling", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  event_type, count(*) AS events, round(sum(value), 6) AS value_sum FROM events GROUP BY ALL""")
def q_stream_tumbling(spark, sf):
    path, schema, files = land_in_time_order(fx.table(spark, sf, "events"), {"ts": CLOSING_TS})
    stream = st.file_stream(spark, path, schema, max_files_per_trigger=files)
    out = st.run_to_sink(st.tumbling_counts(stream), "tumbling")
    res = spark.read.parquet(out)
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "event_type", "events", F.round("value_sum", 6).alias("value_sum"))


@query("stream_rate_limit", BUSY_SQL + "SELECT request_id, user_id, admitted FROM walk")
def q_stream_rate_limit(spark, sf):
    path, schema, files = land_in_time_order(busy_requests(spark, sf), {"ts": CLOSING_TS, "request_id": "-1", "user_id": "-1"})
    stream = st.file_stream(spark, path, schema, max_files_per_trigger=files)
    out = st.run_to_sink(st.stream_rate_limit(stream, BUSY_LIMITS), "ratelimit")
    return spark.read.parquet(out).filter("user_id >= 0")

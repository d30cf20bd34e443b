"""Structured Streaming jobs: file/Kafka ingestion, JSON decoding with quarantine, keyed
encoding for a message sink, watermarked tumbling counts, and the rate limiter as a
stateful stream (state per group of users = admitted times of each one's last window, ≤ limit entries).

Every query writes through a checkpoint location under the shared checkpoint folder, so a
restarted job (or a lost executor) resumes from committed offsets and state.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators.metrics import WINDOW_SECONDS, decide_admissions, role_limit
from quarry.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_stream(spark: SparkSession, bootstrap: str, topics: list[str], group_id: str,
                 starting_offsets: str = "latest") -> DataFrame:
    """Subscribe to topics (needs the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", ",".join(topics)).option("kafka.group.id", group_id)
            .option("startingOffsets", starting_offsets).load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp"))


def files_in_order(spark: SparkSession, path: str, last: str | None = None) -> None:
    """Give the data files of ``path`` modification times in the order of their names and move the
    data files of ``last`` behind them. Time order is what a file stream goes by; on a store that
    keeps no set times, land the files one after another instead."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(folder):
        found = sorted(f.getPath().getName() for f in fs.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-"))
        return [hadoop.Path(folder, n) for n in found]

    files = parts(path)
    for i, f in enumerate(parts(last) if last else []):
        moved = hadoop.Path(path, f"part-z{i:05d}-{f.getName()}")
        fs.rename(f, moved)
        files.append(moved)
    start = max(fs.getFileStatus(f).getModificationTime() for f in files) - 1000 * len(files)
    for i, f in enumerate(files):
        fs.setTimes(f, start + 1000 * i, -1)


def decode_json(df: DataFrame, value_col: str, schema: T.StructType) -> DataFrame:
    """Parse JSON text; undecodable text lands in ``_corrupt_record`` (quarantine) instead
    of an all-null struct, so good and bad rows can be split."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("__j", F.from_json(value_col, full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("*", *[F.col(f"__j.{f.name}").alias(f.name) for f in full.fields]).drop("__j")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB rather than on the executors' heap, unless the session names a store."""
    if spark.conf.get(STATE_STORE, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(STATE_STORE, ""):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_sink(query_df: DataFrame, name: str, output_mode: str = "append",
                partition_by: list[str] | None = None) -> str:
    """Run a streaming DataFrame to completion over the data available now (parquet sink
    with its own checkpoint); returns the sink path."""
    spark = query_df.sparkSession
    keep_state_on_disk(spark)
    base = scratch_path(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    w = (query_df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out


def run_foreach_batch(query_df: DataFrame, name: str, fn, output_mode: str = "append") -> None:
    spark = query_df.sparkSession
    ckpt = os.path.join(scratch_path(spark, name), "checkpoint")
    q = (query_df.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()


def tumbling_counts(events: DataFrame, ts_col: str = "ts", key_col: str = "event_type",
                    window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Watermarked tumbling-window counts (append mode emits a window once closed)."""
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return (ev.groupBy(F.window(ts_col, window).alias("w"), key_col)
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    key_col, "events", "value_sum"))


STATE_SCHEMA = "a_user array<bigint>, a_t array<double>, p_user array<bigint>, p_id array<bigint>, p_t array<double>, p_lim array<int>"
OUT_SCHEMA = "request_id long, user_id long, admitted boolean"
USER_GROUPS = 256  # groups that users are dealt into; a call and a state row each
NO_USER = -1        # the group of requests without a user, which are one user


def _admit_state(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Per group of users: buffer requests until the watermark has passed them, then decide each
    user's in (time, id) order. Rows behind the watermark are dropped by Spark as late, so every
    request that can still arrive is newer than everything already decided. State: the
    admitted times of each user's last window (≤ limit) and the requests still above the watermark,
    kept as parallel arrays. Requests without a time are never decided."""
    a_user, a_t, *held = state.get if state.exists else ([],) * 6
    kinds = {"user_id": np.int64, "request_id": np.int64, "t": np.float64, "lim": np.int64}
    parts = [[np.asarray(v or [], dtype=d) for v, d in zip(held, kinds.values())]]
    if not state.hasTimedOut:
        parts += [[pdf[c].to_numpy(dtype=d) for c, d in kinds.items()] for pdf in pdfs]
    users, ids, ts, lims = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, ts, users))
    users, ids, ts, lims = (x[order] for x in (users, ids, ts, lims))
    wm = state.getCurrentWatermarkMs() / 1000.0
    ready, keep = ts <= wm, ts > wm
    windows: dict[int, deque] = {}
    for u, t in zip(a_user or [], a_t or []):
        windows.setdefault(u, deque()).append(float(t))
    r_user, r_t, r_lim = users[ready], ts[ready], lims[ready]
    decided = np.zeros(len(r_user), dtype=bool)
    ends = np.append(np.flatnonzero(np.diff(r_user)) + 1, len(r_user)) if len(r_user) else []
    start = 0
    for end in ends:
        window = windows.setdefault(int(r_user[start]), deque())
        decided[start:end] = decide_admissions(window, r_t[start:end], r_lim[start:end])
        start = end
    times = [(u, x) for u, window in windows.items() for x in window if x >= wm - WINDOW_SECONDS]
    if keep.any() or times:
        state.update(([u for u, _ in times], [float(x) for _, x in times],
                      users[keep].tolist(), ids[keep].tolist(), ts[keep].tolist(), lims[keep].tolist()))
        wake = float(ts[keep].min()) if keep.any() else wm + WINDOW_SECONDS
        state.setTimeoutTimestamp(int(wake * 1000) + 1)
    elif state.exists:
        state.remove()
    if ready.any():
        yield pd.DataFrame({"request_id": ids[ready], "user_id": r_user if key[0] != NO_USER else np.full(len(r_user), None),
                            "admitted": decided})


def stream_rate_limit(requests_stream: DataFrame, limits: dict | None = None,
                      delay: str = "10 minutes") -> DataFrame:
    """Rate-limit admission as a stateful stream with event-time ordering: requests may arrive
    out of order by up to ``delay``; each is decided once the watermark has passed it, in
    time order, against the admitted times of its user's last window. Requests newer than
    the final watermark stay buffered until later data moves the watermark on. State is kept by
    group of users, so a batch makes ``USER_GROUPS`` calls at most, however many users there are."""
    ev = requests_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    group = F.when(F.col("user_id").isNull(), NO_USER).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(USER_GROUPS)))
    prepared = ev.select(
        "ts", "request_id", group.alias("user_group"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"),
        (F.unix_micros("ts") / 1e6).alias("t"), role_limit("role", limits).cast("int").alias("lim"))
    return prepared.groupBy("user_group").applyInPandasWithState(
        _admit_state, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)

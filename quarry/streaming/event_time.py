"""Event-time jobs: user sessions, replay protection, late rows kept aside, and alerts that are
raised by timers, also where nothing is sent any more.

Streams are watermarked on ``ts``. Rows behind the watermark are dropped by the stateful operators;
``split_late`` in front of them keeps these rows and counts them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.metrics import ALERT_RULES
from quarry.session import scratch_path
from quarry.sources.readers import path_exists
from quarry.streaming.streams import keep_state_on_disk

MINUTE_MS = 60_000


def watermarked(events: DataFrame, delay: str, ts_col: str = "ts") -> DataFrame:
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)


# --- sessions ------------------------------------------------------------------------------------------

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_sessions(events: DataFrame, user_col: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """``(user, session_start, last_event, events, value_sum)`` of every session of a stream: events of
    a user at most ``gap`` apart belong together. A session is emitted when the watermark has
    passed its last event by ``gap``; rows may be out of order by ``delay`` and may join two
    sessions that were apart. Rows without a time are in none, rows without a user are one user.
    Each task merges its rows before the shuffle, so a hot user costs a row per task and session.
    """
    events.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    found = watermarked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), user_col).agg(
        F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
    return found.select(user_col, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                        F.col("last_event").cast("timestamp_ntz").alias("last_event"), "events", "value_sum")


def user_sessions(events: DataFrame, user_col: str = "user_id", gap_seconds: int = 1800) -> DataFrame:
    """The sessions of ``stream_sessions`` over a table. Rows are first reduced to one for each user and
    bucket of ``gap_seconds``, inside which all belong to one session; sessions are then found over
    these, so a user's rows are never gathered, only the buckets of their time span."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = gap_seconds * 1_000_000
    buckets = events.filter("ts is not null").groupBy(user_col, F.floor(us / F.lit(gap)).alias("__b")).agg(
        F.min(us).alias("__first"), F.max(us).alias("__last"), F.count(F.lit(1)).alias("__n"), F.sum("value").alias("__v"))
    w = Window.partitionBy(user_col).orderBy("__b")
    starts = F.when(F.col("__first") - F.lag("__last").over(w) <= gap, 0).otherwise(1)
    numbered = buckets.withColumn("__starts", starts).withColumn("__s", F.sum("__starts").over(w))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return numbered.groupBy(user_col, "__s").agg(
        at(F.min("__first")).alias("session_start"), at(F.max("__last")).alias("last_event"),
        F.sum("__n").alias("events"), F.sum("__v").alias("value_sum")).drop("__s")


# --- replays -------------------------------------------------------------------------------------------

def drop_replays(events: DataFrame, id_col: str = "event_id", delay: str = "1 day") -> DataFrame:
    """Each event of a stream once, however often it is sent again within ``delay`` of event time. Ids
    are kept until the watermark has passed them, so the state stays as large as the events of
    that span. Rows without an id are the same event only if all of their columns agree."""
    own = F.when(F.col(id_col).isNull(), F.xxhash64(*events.columns))
    return watermarked(events, delay).withColumn("__row", own).dropDuplicatesWithinWatermark([id_col, "__row"]).drop("__row")


# --- late rows -----------------------------------------------------------------------------------------

LEDGER = "batch_id long, max_us long, on_time long, late long"


class LateSplit:
    """Micro-batches written once each: rows that are on time, rows behind the watermark, and a ledger.

    A batch's watermark is the greatest time of the batches before it less the delay. (Stateful
    operators drop by the one of the batch before: whatever they would drop is late here.) Both parts of a batch are written under its number, then its ledger row; a
    batch that the ledger has is not written again, and what a stopped run has left of one
    without a ledger row is overwritten. Readers take the batches that the ledger names, so a stop
    between any two steps loses and repeats nothing. Rows without a time are on time.
    """

    def __init__(self, spark, base: str, delay_seconds: float):
        self.spark, self.base, self.delay_us = spark, base, int(delay_seconds * 1_000_000)

    def _folder(self, kind: str, batch_id: int) -> str:
        return os.path.join(self.base, kind, f"batch={batch_id}")

    def ledger(self) -> DataFrame:
        """One row per finished batch."""
        path = os.path.join(self.base, "ledger")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(path).select("batch_id", "max_us", "on_time", "late")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        before = self.ledger().agg(F.count_if(F.col("batch_id") == batch_id).alias("done"),
                                   F.max(F.when(F.col("batch_id") < batch_id, F.col("max_us"))).alias("max_us")).first()
        if before["done"]:
            return
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        late = F.coalesce(us < before["max_us"] - self.delay_us, F.lit(False)) if before["max_us"] is not None else F.lit(False)
        marked = df.withColumn("__late", late)
        # one job writes both parts and counts them
        staged = marked.write.mode("overwrite").partitionBy("__late")
        staged.parquet(self._folder("rows", batch_id))
        done = self.spark.read.schema(df.schema.add("__late", T.BooleanType())).parquet(self._folder("rows", batch_id))
        row = done.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.greatest(F.max(us), F.lit(before["max_us"]).cast("long")).alias("max_us"),
                       F.count_if(~F.col("__late")).alias("on_time"), F.count_if("__late").alias("late"))
        row.coalesce(1).write.mode("overwrite").parquet(self._folder("ledger", batch_id))  # one row

    def rows(self, schema: T.StructType) -> DataFrame:
        """All rows of finished batches, with column ``late``."""
        full = T.StructType([*schema.fields, T.StructField("__late", T.BooleanType()), T.StructField("batch", T.LongType())])
        path = os.path.join(self.base, "rows")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], full).drop("batch").withColumnRenamed("__late", "late")
        written = self.spark.read.schema(full).parquet(path)
        done = self.ledger().select(F.col("batch_id").alias("batch"))
        return written.join(done, "batch", "left_semi").drop("batch").withColumnRenamed("__late", "late")


def split_late(events: DataFrame, name: str, delay_seconds: float, base: str | None = None) -> LateSplit:
    """Run a stream over the data available now through a ``LateSplit`` at ``base`` (a folder that
    keeps the state of earlier runs; without one a fresh scratch folder)."""
    spark = events.sparkSession
    base = base or scratch_path(spark, name)
    split = LateSplit(spark, base, delay_seconds)
    q = (events.writeStream.foreachBatch(split.write).option("checkpointLocation", os.path.join(base, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return split


# --- alerts by timers ----------------------------------------------------------------------------------

class HoldAlert(StatefulProcessor):
    """Fires for every window at which a breach has held for ``hold`` windows without a gap. Breaches wait
    in a list, whatever order they came in; one timer at the first of them takes all that the
    watermark has passed, in order of event time, so a batch costs a metric a few calls however many
    windows it holds. State of a metric: the windows waiting, where the run at hand began and its last window."""

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "start long, last long")
        self.waiting = handle.getListState("waiting", "minute long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _wait(self.handle, self.waiting, rows, "minute", MINUTE_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        m = _passed(self.handle, self.waiting, timerValues.getCurrentWatermarkInMs(), MINUTE_MS)
        if not len(m):
            return
        start, last = self.run.get() if self.run.exists() else (m[0], m[0] - 1)
        begins = np.diff(m, prepend=last) != 1
        starts = np.where(begins, m, np.int64(start) if not begins[0] else m[0])
        starts = np.maximum.accumulate(starts)
        self.run.update((int(starts[-1]), int(m[-1])))
        held = m - starts >= self.hold
        if held.any():
            yield pd.DataFrame({"metric": key[0], "minute": m[held], "run_minute": starts[held]})

    def close(self) -> None:
        pass


class SilenceAlert(StatefulProcessor):
    """Fires when a source that has been heard sends nothing for more than ``hold`` buckets. Buckets in
    which it is heard wait in a list until the watermark has passed their end; one timer takes all
    of these, which gives the silences between them, and one stands where the silence after the last has
    lasted too long. State of a source: the buckets waiting, the last one known and whether the silence
    after it has fired."""

    def __init__(self, bucket_ms: int, hold: int):
        self.bucket_ms, self.hold = bucket_ms, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "bucket long, fired boolean")
        self.heard = handle.getListState("heard", "bucket long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _wait(self.handle, self.heard, rows, "bucket", self.bucket_ms, 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = _passed(self.handle, self.heard, now, self.bucket_ms, 1)
        last, fired = self.last.get() if self.last.exists() else (None, False)
        b = new if last is None else np.append(np.int64(last), new)
        if not len(b):
            return
        silent = np.append(np.diff(b) > self.hold + 1, False)
        silent[0] &= not fired
        # the silence after the last one may have lasted too long already
        ends = int(b[-1] + self.hold + 2) * self.bucket_ms
        told = fired and not len(new)
        silent[-1] = ends <= now and not told
        self.last.update((int(b[-1]), bool(told or silent[-1])))
        if len(new) and ends > now:
            self.handle.registerTimer(ends)
        if silent.any():
            yield pd.DataFrame({"source": key[0], "bucket": b[silent] + 1})

    def close(self) -> None:
        pass


def _wait(handle: StatefulProcessorHandle, waiting, rows: Iterator[pd.DataFrame], col: str, unit_ms: int, after: int = 0) -> None:
    """Add ``col`` of the rows to the list ``waiting``, with one timer at the first of them."""
    new = sorted({int(v) for pdf in rows for v in pdf[col].tolist()})
    if new:
        waiting.appendList([(v,) for v in new])
        handle.registerTimer((new[0] + after) * unit_ms)


def _passed(handle: StatefulProcessorHandle, waiting, now_ms: int, unit_ms: int, after: int = 0) -> np.ndarray:
    """Take from ``waiting`` what the watermark has passed, in order and once each. The rest stays, with
    a timer at its first."""
    held = np.unique(np.array([r[0] for r in waiting.get()] if waiting.exists() else [], dtype=np.int64))
    ready = (held + after) * unit_ms <= now_ms
    if ready.any():
        rest = held[~ready].tolist()
        if rest:
            waiting.put([(v,) for v in rest])
            handle.registerTimer((rest[0] + after) * unit_ms)
        else:
            waiting.clear()
    return held[ready]


def _minutes(ts: Column) -> Column:
    return F.floor(F.unix_timestamp(ts) / 60).cast("long")


def _at(c: str, seconds: int = 60) -> Column:
    return F.timestamp_seconds(F.col(c) * seconds).cast("timestamp_ntz")


def stream_breaches(requests: DataFrame, memory_bytes: str, free_bytes: str, size_bytes: str, delay: str = "10 minutes") -> DataFrame:
    """``(window_start, metric, value)`` of the sliding windows in which a metric breaks its rule:
    error share, mean latency and the gauges (latest reading). Windows are summed in the tasks
    before the shuffle and emitted once the watermark has passed them."""
    latest = F.struct(F.col("ts"), F.col("request_id"), F.col(memory_bytes).alias("memory"),
                      F.try_divide(F.col(free_bytes), F.col(size_bytes)).alias("free"))
    per = watermarked(requests, delay).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(
        (F.count_if(F.col("status").between(500, 599)) / F.count(F.lit(1))).alias("error_ratio"),
        F.avg("duration_s").alias("mean_latency_s"), F.max(latest).alias("last"))
    values = {"error_ratio": F.col("error_ratio"), "mean_latency_s": F.col("mean_latency_s"),
              "memory_gb": F.col("last.memory") / (1 << 30), "free_disk_ratio": F.col("last.free")}
    broken = [F.when((values[m] > limit) if op == ">" else (values[m] < limit), F.struct(F.lit(m).alias("metric"), values[m].cast("double").alias("value")))
              for m, op, limit in ALERT_RULES if m in values]
    return per.select("w", F.explode(F.array_compact(F.array(*broken))).alias("b")).select(
        F.window_time("w").alias("ts"), F.col("w.start").alias("window_start"), "b.metric", "b.value")


def stream_alerts(breaches: DataFrame, hold_minutes: int = 5) -> DataFrame:
    """``(metric, window_start, run_start)``: windows at which a breach has held for ``hold_minutes``. A
    metric has one row per minute of breach, so a task holds little however many requests there are."""
    keep_state_on_disk(breaches.sparkSession)
    keyed = breaches.select("ts", "metric", _minutes(F.col("window_start")).alias("minute")).groupBy("metric")
    fired = keyed.transformWithStateInPandas(HoldAlert(hold_minutes), "metric string, minute long, run_minute long", "append", "EventTime")
    return fired.select("metric", _at("minute").alias("window_start"), _at("run_minute").alias("run_start"))


def stream_silence(events: DataFrame, source_col: str, bucket_seconds: int = 60, hold: int = 1, delay: str = "10 minutes") -> DataFrame:
    """``(source, down_from)``: one row each time a source has been silent for more than ``hold`` buckets,
    as soon as the watermark says so: no row of the source itself is needed. Events are reduced to one
    row for each source and bucket before the timers' state."""
    keep_state_on_disk(events.sparkSession)
    alive = watermarked(events, delay).groupBy(F.window("ts", f"{bucket_seconds} seconds").alias("w"), F.col(source_col).cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = alive.select(F.window_time("w").alias("ts"), "source", F.floor(F.unix_timestamp("w.start") / bucket_seconds).cast("long").alias("bucket"))
    fired = rows.groupBy("source").transformWithStateInPandas(SilenceAlert(bucket_seconds * 1000, hold), "source string, bucket long", "append", "EventTime")
    return fired.select(F.col("source").alias(source_col), _at("bucket", bucket_seconds).alias("down_from"))

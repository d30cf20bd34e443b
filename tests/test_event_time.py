"""Event-time jobs on small streams whose rows, files and stops are chosen by hand."""

import datetime as dt
import math
import os
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import counters as ct
from quarry.plans.bind_streams import BATCHES, land_in_time_order
from quarry.session import scratch_path
from quarry.streaming import event_time as et
from quarry.streaming import streams as st

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(minutes, seconds=0):
    return DAY + dt.timedelta(minutes=minutes, seconds=seconds)


def folder(spark, *files, schema=SCHEMA):
    """A folder of one parquet file per list of rows, in this order."""
    path = scratch_path(spark, "test-stream")
    os.makedirs(path)
    for i, rows in enumerate(files):
        part = scratch_path(spark, "test-file")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        made = next(f for f in os.listdir(part) if f.startswith("part-"))
        os.rename(os.path.join(part, made), os.path.join(path, f"part-{i:03d}.parquet"))
        os.utime(os.path.join(path, f"part-{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def stream(spark, path, schema=SCHEMA):
    return st.file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files_per_trigger=1)


def result(spark, df, name):
    return spark.read.schema(df.schema).parquet(st.run_to_sink(df, name))


CLOSE = (-1, at(60 * 24 * 30), -1, "close", 0.0)


def test_sessions_join_when_a_row_between_them_comes_late(spark):
    path = folder(spark,
                  [(1, at(0), 7, "a", 1.0), (2, at(50), 7, "a", 2.0), (3, at(50), 7, "a", 2.0), (4, None, 7, "a", 9.0), (5, at(50), None, "a", 4.0)],
                  [(6, at(25), 7, "a", 3.0), (7, at(80, 1), 7, "a", 5.0)],   # joins 0 and 50; the last is more than a gap after 50
                  [(8, at(79, 59), 8, "a", 1.0), (9, at(109, 59), 8, "a", 1.0)], [CLOSE])
    df = et.stream_sessions(stream(spark, path), delay="2 hours")
    got = {(r["user_id"], r["session_start"], r["last_event"], r["events"], r["value_sum"]) for r in result(spark, df, "s").collect() if r["user_id"] != -1}
    want = {(7, at(0), at(50), 4, 8.0), (7, at(80, 1), at(80, 1), 1, 5.0), (None, at(50), at(50), 1, 4.0), (8, at(79, 59), at(109, 59), 2, 2.0)}
    assert got == want
    rows = spark.read.schema(SCHEMA).parquet(path).filter("user_id is null or user_id <> -1")
    assert {tuple(r) for r in et.user_sessions(rows).select("user_id", "session_start", "last_event", "events", "value_sum").collect()} == want
    assert et.user_sessions(rows.limit(0)).count() == 0


def test_sessions_drop_what_is_behind_the_watermark(spark):
    path = folder(spark, [(1, at(0), 7, "a", 1.0)], [(2, at(300), 7, "a", 1.0)], [(4, at(301), 9, "a", 1.0)], [(3, at(5), 7, "a", 1.0)], [CLOSE])
    got = result(spark, et.stream_sessions(stream(spark, path)), "s").filter("user_id = 7").orderBy("session_start").collect()
    assert [(r["session_start"], r["events"]) for r in got] == [(at(0), 1), (at(300), 1)]


def test_replays_in_and_across_batches_come_once_and_state_falls(spark):
    first = [(k, at(k), 1, "a", float(k)) for k in range(100)]
    nulls = [(None, at(3), 1, "a", 1.0), (None, at(3), 1, "a", 1.0), (None, at(3), 2, "a", 1.0)]
    path = folder(spark, first + first[::10] + nulls, first[50:] + [(200, at(120), 1, "b", 0.0)] + nulls[:1],
                  [(300, at(60 * 24 * 3), 1, "c", 0.0)], [CLOSE])
    spark.conf.set(st.STATE_STORE, "")
    st.keep_state_on_disk(spark)
    once = et.drop_replays(stream(spark, path), delay="1 day")
    base = scratch_path(spark, "replay")
    q = once.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/c").trigger(availableNow=True).start()
    q.awaitTermination()
    ids = [r["event_id"] for r in spark.read.parquet(base + "/out").collect()]
    assert sorted(i for i in ids if i is not None) == sorted([-1, *range(100), 200, 300]) and ids.count(None) == 2
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) >= 103 and kept[-1] <= 2


def late_files(spark):
    return folder(spark, [(1, at(0), 1, "a", 0.0), (2, None, 1, "a", 0.0)], [(3, at(100), 1, "a", 0.0), (4, at(-30), 1, "a", 0.0)],
                  [(5, at(39), 1, "a", 0.0), (6, at(40), 1, "a", 0.0), (7, at(5), 1, "a", 0.0), (7, at(5), 1, "a", 0.0)], [(8, at(0), 1, "a", 0.0)])


LATE = [(1, False), (2, False), (3, False), (4, False), (5, True), (6, False), (7, True), (7, True), (8, True)]


def test_late_rows_are_kept_aside_and_counted(spark):
    source = stream(spark, late_files(spark))
    split = et.split_late(source, "late", 3600)
    rows = split.rows(source.schema)
    assert sorted((r["event_id"], r["late"]) for r in rows.collect()) == LATE
    totals = split.ledger().agg(F.sum("on_time"), F.sum("late")).first()
    assert tuple(totals) == (5, 4)
    empty = et.split_late(stream(spark, folder(spark, [])), "late", 3600)
    assert empty.rows(source.schema).count() == 0


@pytest.mark.parametrize("stop", ["before rows", "before ledger", "after ledger"])
def test_a_run_that_stops_between_any_two_steps_is_taken_up_again(spark, monkeypatch, stop):
    source, base = stream(spark, late_files(spark)), scratch_path(spark, "late-stopped")
    whole = et.LateSplit.write
    calls = []

    def stopping(self, df, batch_id):
        calls.append(batch_id)
        if len(calls) == 3:  # the third batch does not get through
            if stop == "before ledger":
                df.limit(1).withColumn("__late", F.lit(False)).write.partitionBy("__late").parquet(self._folder("rows", batch_id))
            if stop == "after ledger":
                whole(self, df, batch_id)
            raise RuntimeError("stopped")
        whole(self, df, batch_id)
    monkeypatch.setattr(et.LateSplit, "write", stopping)
    with pytest.raises(Exception, match="stopped"):
        et.split_late(source, "late", 3600, base)
    split = et.split_late(source, "late", 3600, base)
    assert calls.count(calls[2]) == 2
    assert sorted((r["event_id"], r["late"]) for r in split.rows(source.schema).collect()) == LATE


def breaches(spark, *files):
    schema = "ts timestamp, metric string, window_start timestamp_ntz"
    path = folder(spark, *[[(at(m), name, at(m)) for name, m in rows] for rows in files], [(at(60 * 24 * 9), "close", at(60 * 24 * 9))], schema=schema)
    return stream(spark, path, schema).withWatermark("ts", "30 minutes")


def test_alerts_hold_whatever_the_order_of_breaches(spark):
    df = et.stream_alerts(breaches(spark, [("x", m) for m in (3, 1, 2, 2)] + [("y", 1)], [("x", 0), ("x", 5), ("x", 4), ("y", 3)],
                                   [("x", 8), ("x", 7), ("y", 2), ("y", 4)]), hold_minutes=3)
    got = sorted((r["metric"], r["window_start"], r["run_start"]) for r in result(spark, df, "alerts").collect())
    assert got == [("x", at(3), at(0)), ("x", at(4), at(0)), ("x", at(5), at(0)), ("y", at(4), at(1))]


def test_a_silent_source_fires_though_it_sends_nothing(spark):
    rows = [[(1, at(0), 1, "a", 0.0), (2, at(0, 5), 1, "b", 0.0), (3, at(2), 1, "b", 0.0), (4, at(1), 1, "a", 0.0)],
            [(5, at(4), 1, "b", 0.0), (6, at(3), 1, "b", 0.0), (7, at(9), 1, "a", 0.0), (8, at(20), 1, None, 0.0)]]
    path = folder(spark, *rows, [(-1, at(40, 601), 1, "close", 0.0)])
    df = et.stream_silence(stream(spark, path), "event_type", hold=2)
    got = sorted((r["event_type"], r["down_from"]) for r in result(spark, df, "silence").collect() if r["event_type"])
    # b is silent for one minute at 1, which is held; both fall silent for good
    assert got == [("a", at(2)), ("a", at(10)), ("b", at(5))]


class Handle:
    """State and timers of one key in memory, which counts the timers set."""

    def __init__(self):
        self.timers, self.set = set(), 0

    def registerTimer(self, ms):
        self.set += 1
        self.timers.add(ms)

    def getValueState(self, name, schema):
        return Held()

    def getListState(self, name, schema):
        return Held()


class Held:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return iter(list(self.v)) if isinstance(self.v, list) else self.v

    def update(self, v):
        self.v = v

    def put(self, v):
        self.v = list(v)

    def appendList(self, v):
        self.v = (self.v or []) + list(v)

    def clear(self):
        self.v = None


def walked(processor, col, batches):
    """Rows that come out of batches of ``(values, watermark)``, and how many timers were set."""
    handle, out = Handle(), []
    processor.init(handle)
    for values, now in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
        processor.handleInputRows(("k",), iter([pd.DataFrame({col: values})]) if values else iter([]), clock)
        for t in sorted(t for t in handle.timers if t <= now):
            for pdf in processor.handleExpiredTimer(("k",), clock, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)):
                out += [tuple(r) for r in pdf.itertuples(index=False)]
            handle.timers.discard(t)
    return out, handle.set


def test_alerts_and_silences_set_a_few_timers_a_batch_and_find_what_a_plain_walk_finds():
    import random
    rnd = random.Random(11)
    minutes = [m for m in range(3000) if rnd.random() < 0.7]
    for per in (50, 1000):
        # out of order by up to 40 minutes: the watermark stays behind by as much
        near = sorted(minutes, key=lambda m: m + rnd.random() * 40)
        batches = [(near[i:i + per], (max(near[:i + per]) - 40) * 60_000) for i in range(0, len(near), per)] + [([], 9_000 * 60_000)]
        found, timers = walked(et.HoldAlert(5), "minute", batches)
        want, start = [], None
        for i, m in enumerate(minutes):
            start = start if i and minutes[i - 1] == m - 1 else m
            want += [("k", m, start)] if m - start >= 5 else []
        assert found == want and timers <= 4 * len(batches)
        found, timers = walked(et.SilenceAlert(60_000, 2), "bucket", batches)
        assert found == [("k", m + 1) for m, n in zip(minutes, minutes[1:] + [10 ** 6]) if n - m > 3] and timers <= 4 * len(batches)


def test_a_replay_has_a_bounded_number_of_batches(spark):
    rows = spark.range(2000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) as ts", "id % 7 as user_id", "'a' as event_type", "1D as value")
    path, schema, files = land_in_time_order(rows, {"ts": "ts + INTERVAL 30 DAYS", "user_id": "-1"}, rows_per_file=20)
    source = st.file_stream(spark, path, schema, max_files_per_trigger=files)
    sizes = []
    st.run_foreach_batch(source, "replayed", lambda df, n: sizes.append((df.count(), df.agg(F.min("ts"), F.max("ts")).first())))
    assert sum(n for n, _ in sizes) == 2001 and 2 < len(sizes) <= BATCHES + 1
    assert all(a[1] < b[0] for (_, a), (_, b) in zip(sizes, sizes[1:]))  # in time order
    got = result(spark, st.tumbling_counts(source), "t").groupBy().sum("events").first()[0]
    assert got == 2000


# --- histograms and counters -----------------------------------------------------------------------------

def plain_bucket_quantile(values, bounds, q):
    if not values:
        return None
    counts = [sum(v <= b for v in values) for b in bounds] + [len(values)]
    rank = q * len(values)
    k = next(i for i, c in enumerate(counts) if c >= rank)
    if k == len(bounds):
        return bounds[-1]
    if k == 0 and bounds[0] <= 0:
        return bounds[0]
    low, before = (bounds[k - 1], counts[k - 1]) if k else (0.0, 0)
    return low + (bounds[k] - low) * (rank - before) / (counts[k] - before) if counts[k] > before else None


@pytest.mark.parametrize("values", [[0.2], [0.1, 0.1, 0.3], [20.0, 30.0], [0.004, 11.0, 0.7, 0.7], [None, None], [float("nan"), 0.05], [-1.0, 0.0]])
@pytest.mark.parametrize("q", [0.5, 0.95, 1.0])
def test_bucket_quantiles_by_the_definition(spark, values, q):
    rows = spark.createDataFrame([(at(0, k), v) for k, v in enumerate(values)], "ts timestamp_ntz, duration_s double")
    got = ct.histogram_quantiles(rows, {"v": q}).filter(F.col("window_start") == F.lit(at(0))).first()
    real = [v for v in values if v is not None and not math.isnan(v)]
    want = plain_bucket_quantile(real, ct.LATENCY_BOUNDS, q)
    assert got["requests"] == len(real) and (got["v"] == pytest.approx(want) if want is not None else got["v"] is None)


def test_bucket_quantiles_with_bounds_below_zero_and_of_an_empty_table(spark):
    rows = spark.createDataFrame([(at(0), -3.0), (at(1), 2.0)], "ts timestamp_ntz, duration_s double")
    got = {r["window_start"]: r["v"] for r in ct.histogram_quantiles(rows, {"v": 0.4}, bounds=(-1.0, 4.0)).collect()}
    assert got[at(0)] == -1.0 and got[at(1)] == pytest.approx(1.0)
    assert ct.histogram_quantiles(rows.limit(0), {"v": 0.5}).count() == 0


def plain_rate(samples, start, minutes=5):
    own = sorted((t, v) for t, v in samples if start <= t < start + dt.timedelta(minutes=minutes))
    if len(own) < 2 or own[0][0] == own[-1][0]:
        return None
    raw = sum(b - a if b >= a else b for (_, a), (_, b) in zip(own, own[1:]))
    span = (own[-1][0] - own[0][0]).total_seconds()
    mean = span / (len(own) - 1)
    front = (own[0][0] - start).total_seconds()
    back = (start + dt.timedelta(minutes=minutes) - own[-1][0]).total_seconds()
    front, back = (mean / 2 if x >= 1.1 * mean else x for x in (front, back))
    if raw > 0 and own[0][1] >= 0:
        front = min(front, span * own[0][1] / raw)
    return raw * (span + front + back) / span


def test_counter_rates_by_the_definition(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for name in ("a", "b"):
        t, v = 0.0, 0.0
        while t < 1500:
            t += rnd.choice([2, 15, 30, 200])
            v = 0.0 if rnd.random() < 0.15 else v + rnd.randint(0, 9)
            rows.append((name, at(0, t), v))
    odd = [(None, at(1), 5.0), ("a", None, 5.0), ("a", at(2), None), ("a", at(2), float("nan")), ("once", at(3), 7.0), ("tie", at(3), 1.0), ("tie", at(3), 2.0)]
    df = spark.createDataFrame(rows + odd, "series string, ts timestamp_ntz, value double")
    got = {(r["series"], r["window_start"]): r["increase"] for r in ct.counter_rate(df, "series").collect()}
    want = {}
    for name in ("a", "b"):
        for m in range(-5, 30):
            x = plain_rate([(t, v) for n, t, v in rows if n == name], at(m))
            if x is not None:
                want[name, at(m)] = x
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert ct.counter_rate(df.limit(0), "series").count() == 0


def test_folders_without_a_ledger_are_empty(spark):
    split = et.LateSplit(spark, os.path.join(scratch_path(spark, "none"), "x"), 60)
    assert split.ledger().count() == 0 and split.rows(spark.createDataFrame([], SCHEMA).schema).count() == 0

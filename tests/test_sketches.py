"""Sketch metrics against the exact ones, on windows that hold many users and values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as mt
from quarry.operators import sketches as sk
from quarry.plans.bind_event_time import RANK_BOUND, USERS_BOUND
from quarry.session import scratch_path
from quarry.streaming import streams as st

KEY = ["window_start", "window_end"]
SCHEMA = "ts timestamp_ntz, user_id long, duration_s double"


@pytest.fixture(scope="module")
def dense(spark):
    """60,000 requests in 12 minutes; a third of them by one user, some without a user or a value."""
    n = F.col("id")
    user = F.when(n % 3 == 0, 7).when(n % 101 == 0, None).otherwise(F.pmod(F.xxhash64(n), F.lit(20_000)))
    value = F.when(n % 97 != 0, F.pow(F.pmod(F.xxhash64(n, F.lit(1)), F.lit(10_000)) / 1000.0, F.lit(3.0)))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + n % 720).cast("timestamp_ntz")
    return spark.range(60_000).select(ts.alias("ts"), user.cast("long").alias("user_id"), value.alias("duration_s"))


def test_users_are_near_the_exact_count(dense):
    exact = {tuple(r[:2]): r[2] for r in mt.active_users(dense).select(*KEY, "active_users").collect()}
    about = {tuple(r[:2]): r[2] for r in sk.approx_active_users(dense).select(*KEY, "active_users").collect()}
    assert exact.keys() == about.keys() and max(exact.values()) > 5_000
    assert all(abs(about[k] - exact[k]) <= USERS_BOUND * exact[k] for k in exact)


def test_quantiles_are_near_their_rank(dense):
    about = sk.approx_latency(dense)
    rows = sk.true_ranks(dense, about).join(about, KEY).collect()
    assert len(rows) == 16
    for r in rows:
        assert r["low50"] <= 0.5 + RANK_BOUND and r["high50"] >= 0.5 - RANK_BOUND
        assert r["low95"] <= 0.95 + RANK_BOUND and r["high95"] >= 0.95 - RANK_BOUND
    # every value is in five windows
    assert sum(r["n"] for r in rows) == 5 * dense.filter("duration_s is not null").count()


def test_a_wrong_estimate_shows_in_its_rank(dense):
    wrong = sk.approx_latency(dense).withColumn("q50", F.col("q95"))
    assert all(r["low50"] > 0.5 + RANK_BOUND for r in sk.true_ranks(dense, wrong).collect())


def test_nulls_ties_and_empty_tables(spark):
    at = dt.datetime(2024, 1, 1, 0, 10)
    rows = spark.createDataFrame([(at, None, None), (at, None, 1.0), (at, 3, 1.0), (at, 3, 1.0), (None, 4, 9.0)], SCHEMA)
    assert [r["active_users"] for r in sk.approx_active_users(rows).collect()] == [2] * 5
    assert [(r["n"], r["q50"], r["q95"]) for r in sk.approx_latency(rows).collect()] == [(3, 1.0, 1.0)] * 5
    assert sk.approx_active_users(rows.limit(0)).count() == 0
    assert sk.approx_latency(rows.filter("duration_s is null")).count() == 0


def test_stream_gives_the_windows_of_the_batch(spark, dense):
    path = scratch_path(spark, "test-sketch")
    dense.filter("second(ts) < 30").repartition(1).write.parquet(path)
    dense.filter("second(ts) >= 30").repartition(1).write.mode("append").parquet(path)
    closing = spark.createDataFrame([(dt.datetime(2024, 2, 1), -1, None)], SCHEMA)
    closing.repartition(1).write.mode("append").parquet(path)
    stream = st.file_stream(spark, path, spark.read.parquet(path).schema, max_files_per_trigger=1)
    out = spark.read.parquet(st.run_to_sink(sk.stream_active_users(stream, delay="1 hour"), "sketch"))
    got = {r["window_start"]: r["active_users"] for r in out.filter("window_start < '2024-01-15'").collect()}
    want = {r["window_start"]: r["active_users"] for r in mt.active_users(dense).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= USERS_BOUND * want[k] for k in want)

"""Semantics of the custom operators against plain-Python models on small inputs."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import calendar as cal
from quarry.operators import quality as dq
from quarry.operators import structure
from quarry.operators.quantiles import exact_quantiles
from quarry.session import scratch_path
from quarry.sources import readers as rd
from quarry.sources import sinks as sk
from quarry.streaming import streams


# (case, base, override, merged: path → (value, side))
MERGES = [
    ("members are merged, the override wins", '{"a":1,"m":{"x":1,"y":2}}', '{"m":{"y":3,"z":4}}',
     {"a": ("1", "base"), "m.x": ("1", "base"), "m.y": ("3", "override"), "m.z": ("4", "override")}),
    ("an object replaces a scalar", '{"a":1,"m":5}', '{"m":{"q":9}}', {"a": ("1", "base"), "m.q": ("9", "override")}),
    ("a scalar replaces an object, with all below it", '{"m":{"x":{"p":1,"q":{"r":2}}}}', '{"m":{"x":7}}', {"m.x": ("7", "override")}),
    ("any depth", '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1,"keep":9}}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":2}}}}}}}',
     {"a.b.c.d.e.f.g": ("2", "override"), "a.b.c.d.e.f.keep": ("9", "base")}),
    ("empty objects", '{"e":{},"f":{"x":1},"g":{},"h":3}', '{"f":{},"g":{"y":2},"h":{}}',
     {"e": ("{}", "base"), "f.x": ("1", "base"), "g.y": ("2", "override"), "h": ("{}", "override")}),
    ("texts that look like objects", '{"t":"{x","j":"{\\"x\\":1}","k":{"x":1}}', '{"k":"{}"}',
     {"t": ("{x", "base"), "j": ('{"x":1}', "base"), "k": ("{}", "override")}),
    ("dots and backslashes in names", '{"a.b":1,"c":{"d.e":2}}', '{"a":{"b":3},"w\\\\x":4}',
     {r"a\.b": ("1", "base"), r"c.d\.e": ("2", "base"), "a.b": ("3", "override"), r"w\\x": ("4", "override")}),
    ("arrays and nulls are values", '{"l":[1,{"x":2}],"n":1}', '{"n":null}', {"l": ('[1,{"x":2}]', "base"), "n": ("null", "override")}),
    ("null base", None, '{"a":1}', {"a": ("1", "override")}),
    ("null override", '{"a":1}', None, {"a": ("1", "base")}),
    ("both null", None, None, {"": (None, "override")}),
    ("unparsable override", '{"a":1}', '{"a":', {"a": ("1", "base")}),
    ("both empty", "{}", "{}", {"": ("{}", "override")}),
]


def test_deep_merge(spark):
    base = spark.createDataFrame([(i, m[1]) for i, m in enumerate(MERGES)] + [(99, '{"only":"base"}')], "id long, doc string")
    over = spark.createDataFrame([(i, m[2]) for i, m in enumerate(MERGES)] + [(98, '{"only":"over"}')], "id long, doc string")
    got = {}
    for r in structure.deep_merge(base, over, "id", "doc").collect():
        assert r["path"] not in got.setdefault(r["id"], {})
        got[r["id"]][r["path"]] = (r["value"], r["origin"])
    for i, (case, _, _, want) in enumerate(MERGES):
        assert got[i] == want, case
    assert got[99] == {"only": ("base", "base")} and got[98] == {"only": ("over", "override")}
    same = structure.deep_merge(base, base, "id", "doc").select("id", "path", "value")
    own = {(r["id"], r["path"], r["value"]) for r in same.collect()}
    assert own == {(r["id"], r["path"], r["value"]) for r in structure.json_entries(base, "id", "doc").select(
        "id", structure.path_text(F.col("parts")).alias("path"), "value").collect()}


def test_exact_quantiles_with_hot_group(spark):
    random.seed(3)
    rows = [(0 if i % 3 == 0 else i % 7, i, random.random()) for i in range(3000)]  # group 0 holds a third
    df = spark.createDataFrame(rows, "g long, id long, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in
           exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([r[2] for r in rows if r[0] == g])
        assert abs(got[g][0] - float(np.quantile(vals, 0.5))) < 1e-12
        assert abs(got[g][1] - float(np.quantile(vals, 0.95))) < 1e-12


def test_exact_quantiles_cut_large_buckets_again(spark, monkeypatch):
    """Every bucket is above the bound at first; skewed values, copies, a fine key and two signs."""
    from quarry.operators import quantiles
    monkeypatch.setattr(quantiles, "SPLITS", 2)
    monkeypatch.setattr(quantiles, "CUTS", 3)
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 5)
    random.seed(4)
    rows = [("ab"[i % 2], 7.0 if i % 3 == 0 else random.choice([-1, 1]) * 10 ** random.uniform(-30, 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"p10": 0.1, "p50": 0.5, "p77": 0.77}
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        v = np.sort([x for g, x in rows if g == r["g"]])
        for name, p in probs.items():
            at = p * (len(v) - 1)
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert r[name] == pytest.approx(lo + (at - np.floor(at)) * (hi - lo), rel=1e-9)


def test_readers_split_files_and_keep_bad_columns_as_text(spark, tmp_path):
    from quarry.sources import readers
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},{'x' if i == 3 else i}\n" for i in range(40)))
    path = str(tmp_path / "t.csv")
    assert dict(readers.read_any(spark, path).dtypes) == {"a": "bigint", "b": "bigint"}
    got = readers.extract_tables(spark, {"t": path}, multi_line=False, bad_share=0)["t"]
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"} and got.filter("b = 'x'").count() == 1 and got.count() == 40


def test_exact_quantiles_with_ties_nulls_and_null_group(spark):
    rows = [("a", 1.0)] * 700 + [("a", float(i)) for i in range(300)] + [(None, 5.0), (None, None), (None, 9.0), ("c", 2.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.9}).collect()}
    assert got == {"a": float(np.quantile([v for g, v in rows if g == "a"], 0.9)), None: 8.6, "c": 2.5}


def test_business_days_match_python(spark):
    holidays = spark.createDataFrame([(dt.date(2024, 7, 4),), (dt.date(2024, 12, 25),)], "holiday date")
    hol = {dt.date(2024, 7, 4), dt.date(2024, 12, 25)}
    random.seed(5)
    pairs = []
    for i in range(200):
        a = dt.date(2024, 1, 1) + dt.timedelta(days=random.randint(0, 360))
        b = a + dt.timedelta(days=random.randint(-40, 40))
        pairs.append((i, a, b))
    df = spark.createDataFrame(pairs, "i long, a date, b date")
    got = {r["i"]: r["business_days"] for r in cal.business_days_between(df, "a", "b", holidays).collect()}
    for i, a, b in pairs:
        lo, hi = min(a, b), max(a, b)
        n = sum(1 for k in range((hi - lo).days + 1)
                if (lo + dt.timedelta(days=k)).weekday() < 5 and lo + dt.timedelta(days=k) not in hol)
        assert got[i] == n
    nxt = {r["i"]: r["next_business_day"] for r in cal.next_business_day(df, "a", holidays).collect()}
    for i, a, _ in pairs:
        d = a + dt.timedelta(days=1)
        while d.weekday() >= 5 or d in hol:
            d += dt.timedelta(days=1)
        assert nxt[i] == d


def test_next_business_day_beyond_any_run_of_holidays(spark):
    off = [dt.date(2024, 1, 2) + dt.timedelta(days=i) for i in range(90)]
    holidays = spark.createDataFrame([(d,) for d in off], "holiday date")
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "a date")
    assert cal.next_business_day(df, "a", holidays).first()["next_business_day"] == dt.date(2024, 4, 1)


def test_unique_flags_every_duplicate_and_ignores_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k long")
    r = dq.unique_check(df, "k").first()
    assert (r["evaluated"], r["unexpected"]) == (3, 2)


def test_suite_value_checks_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None, "x@y.io"), (2, 7.0, "bad")], "employee_id long, r double, email string")
    res = {r["expectation"] + ":" + r["column_name"]: r for r in dq.run_suite(df, [
        dq.Expectation("between", "r", {"min": 0.0, "max": 5.0}),
        dq.Expectation("regex", "email", {"pattern": dq.EMAIL_STRICT}),
        dq.Expectation("exists", "missing_col")], "t").collect()}
    assert res["expect_column_values_to_be_between:r"]["unexpected"] == 1
    assert res["expect_column_values_to_be_between:r"]["evaluated"] == 1
    assert res["expect_column_values_to_match_regex:email"]["unexpected"] == 1
    assert not res["expect_column_to_exist:missing_col"]["success"]


def test_csv_null_tokens_and_sniffing(spark):
    path = os.path.join(scratch_path(spark, "csv-test"), "t.csv")
    df = spark.createDataFrame([("1", "N/A", "2024-01-02", "a"), ("2", "3.5", "2024-02-03", "NULL"),
                                ("3", "", "2024-03-04", "c")], "id string, x string, d string, s string")
    sk.write_csv(df.coalesce(1), path)
    out = rd.read_csv_nulls(spark, path)
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert types == {"id": "bigint", "x": "double", "d": "date", "s": "string"}
    rows = sorted(out.collect())
    assert [r["x"] for r in rows] == [None, 3.5, None] and rows[1]["s"] is None


def test_csv_quotes_line_breaks_and_dotted_names(spark):
    path = os.path.join(scratch_path(spark, "csv-quotes"), "t.csv")
    rows = [('say "hi", ok', 1, "x"), ("two\nlines", 2, '"'), (None, 3, " blank "), ("", 4, "a,b")]
    df = spark.createDataFrame(rows, "note string, id long, `home.city` string")
    sk.write_csv(df.coalesce(1), path)
    out = rd.read_csv_nulls(spark, path)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.orderBy("id").collect() if r["note"]) == sorted(r for r in rows if r[0])
    assert out.filter("note is null").count() == 2  # the empty text is a null token


def test_csv_bad_values_become_null(spark):
    path = os.path.join(scratch_path(spark, "csv-bad"), "t.csv")
    df = spark.range(100).selectExpr("id", "if(id = 7, '1x', cast(id as string)) as n", "if(id < 50, 'word', cast(id as string)) as mixed")
    sk.write_csv(df.coalesce(1), path)
    out = rd.read_csv_nulls(spark, path)
    assert dict(out.dtypes) == {"id": "bigint", "n": "bigint", "mixed": "string"}
    assert out.filter("n is null").select("id").collect()[0]["id"] == 7
    declared = rd.read_csv_nulls(spark, path, schema=spark.range(0).selectExpr("cast(1 as double) as mixed", "cast(1 as int) as n").schema)
    assert declared.filter("mixed is null").count() == 50 and declared.filter("n is null").count() == 1


def test_summary_lines_are_csv(spark):
    df = spark.createDataFrame([("a,b", 1.005e30, 'q"q'), (None, 2.0, "x")], "name string, v double, n string")
    lines = sorted(r["line"] for r in sk.summary_to_docs(df).collect())
    assert lines == ['"a,b",1004999999999999980000000000000.00,"q""q"', ",2.00,x"] or lines[1] == ",2.00,x"


def test_stream_decode_quarantines_bad_json(spark):
    path = os.path.join(scratch_path(spark, "json-test"), "in")
    spark.createDataFrame([(1, '{"k": 5}'), (2, "not json"), (3, '{"k": 7}')],
                          "event_id long, props string").write.parquet(path)
    src = streams.file_stream(spark, path, spark.read.parquet(path).schema)
    dec = streams.decode_json(src, "props", spark.createDataFrame([], "k long").schema)
    out = streams.run_to_sink(dec.select("event_id", "k", "_corrupt_record"), "json-test-out")
    got = {r["event_id"]: (r["k"], r["_corrupt_record"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (5, None), 2: (None, "not json"), 3: (7, None)}


def test_tumbling_stream_equals_batch_on_closed_windows(spark, sf_dir):
    from quarry.plans import fixtures as fx
    events = fx.table(spark, sf_dir, "events")
    path = os.path.join(scratch_path(spark, "tumble-test"), "in")
    events.write.parquet(path)
    src = streams.file_stream(spark, path, events.schema)
    out = spark.read.parquet(streams.run_to_sink(streams.tumbling_counts(src), "tumble-test-out"))
    got = {(r["window_start"], r["event_type"]): r["events"] for r in out.collect()}
    ev = events.withColumn("ts", F.col("ts").cast("timestamp"))
    max_ts = ev.agg(F.max("ts")).first()[0]
    batch = (ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
             .filter(F.col("w.end") <= F.lit(max_ts) - F.expr("INTERVAL 10 MINUTES")))
    expect = {(r["w"]["start"], r["event_type"]): r["count"] for r in batch.collect()}
    assert got == expect and len(got) > 0


def test_sliding_requests_bucketed_matches_python(spark):
    from quarry.operators import metrics
    random.seed(11)
    rows = []
    for i in range(1500):
        user = 0 if i % 2 else random.randint(1, 20)  # user 0 is hot
        t = random.choice([0, 59.999999, 60.0, 120.0]) if i % 7 == 0 else random.uniform(0, 600)
        rows.append((i, user, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=round(t, 6))))
    df = spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp_ntz")
    got = {r["request_id"]: r["requests_60s"] for r in metrics.sliding_requests(df).collect()}
    for rid, u, ts in rows:
        n = sum(1 for _, u2, ts2 in rows if u2 == u and ts - dt.timedelta(seconds=60) <= ts2 <= ts)
        assert got[rid] == n


def test_shrink_types_keeps_values(spark):
    df = spark.createDataFrame([(1, 300, 70000, 2 ** 40, "x")], "a long, b long, c long, d long, s string")
    out = structure.shrink_types(df, persist=False)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["tinyint", "smallint", "int", "bigint", "string"]
    assert tuple(out.first()) == (1, 300, 70000, 2 ** 40, "x")


def test_flatten_nested_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "m": {"x": "u", "y": {"z": 2.5}}}'), (2, '{"a": 3}')],
                               "id long, j string")
    out = structure.flatten_json(df, "j", keep=["id"])
    assert out.columns == ["id", "a", "m.x", "m.y.z"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "u", 2.5), (2, 3, None, None)]


def test_hashing_encoder_unit_norm(spark):
    from quarry.operators import documents as dm
    df = spark.createDataFrame([("h1", "a b c a"), ("h2", "zz")], "text_hash string, text string")
    vecs = {r["text_hash"]: r["embedding"] for r in dm.hashing_encoder(16)(df).collect()}
    for v in vecs.values():
        assert len(v) == 16 and abs(sum(x * x for x in v) - 1.0) < 1e-5


def test_gate_enforce_raises_on_failure(spark):
    import pytest
    bad = spark.createDataFrame([("t1", 0, "PASSED"), ("t2", 2, "FAILED")],
                                "table_name string, failed_checks int, status string")
    with pytest.raises(ValueError, match="t2"):
        dq.enforce(bad)
    dq.enforce(bad.filter("status = 'PASSED'"))


def test_foreach_batch_sink(spark):
    path = os.path.join(scratch_path(spark, "feb-test"), "in")
    spark.range(0, 50).write.parquet(path)
    seen = []
    src = streams.file_stream(spark, path, spark.read.parquet(path).schema)
    streams.run_foreach_batch(src, "feb-test-run", lambda df, epoch: seen.append(df.count()))
    assert sum(seen) == 50

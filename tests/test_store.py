"""Keyed loads that are stopped anywhere leave the old tables or the new ones, never anything between."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import documents as doc
from quarry.operators import jobs
from quarry.session import scratch_path
from quarry.sources import store


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def held(spark, root, name="t"):
    return sorted((tuple(r) for r in store.read_table(spark, root, name).collect()), key=str)


def test_a_load_replaces_by_key_and_writes_only_the_buckets_it_touches(spark):
    root = scratch_path(spark, "store")
    assert store.tables(spark, root) == []
    n = store.load(spark.range(1000).select("id", F.lit("old").alias("v")), root, "t", ["id"], buckets=16)
    assert n == 1000
    _, before = store.current(spark, root)
    reader = store.read_table(spark, root, "t")
    assert store.load(rows(spark, (3, "new"), (3, "newer"), (5000, "added")), root, "t", ["id"], order=["v"]) == 1001
    version, after = store.current(spark, root)
    changed = {b for b, f in after["t"]["folders"].items() if before["t"]["folders"].get(b) != f}
    assert version == 2 and len(changed) <= 2
    got = dict(held(spark, root))
    assert got[3] == "newer" and got[5000] == "added" and got[4] == "old" and len(got) == 1001
    assert reader.count() == 1000  # what was read before stays as it was
    with pytest.raises(ValueError, match="kept by"):
        store.load(rows(spark, (1, "x")), root, "t", ["v"])
    with pytest.raises(ValueError, match="no table"):
        store.read_table(spark, root, "other")


def test_empty_loads_nulls_and_new_keys_only(spark):
    root = scratch_path(spark, "store")
    assert store.load(spark.createDataFrame([], "id long, v string"), root, "t", ["id"]) == 0
    assert held(spark, root) == []
    assert store.load(rows(spark, (1, "a"), (1, "a"), (None, "n")), root, "t", ["id"]) == 2
    assert store.load(spark.createDataFrame([], "id long, v string"), root, "t", ["id"]) == 2
    assert store.load(rows(spark, (1, "b"), (2, "c")), root, "t", ["id"], replace=False) == 3
    assert held(spark, root) == sorted([(1, "a"), (2, "c"), (None, "n")], key=str)


STEPS = ["_written", "_put"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("done", [False, True])
def test_a_load_that_stops_leaves_the_old_table_or_the_new_one(spark, monkeypatch, step, done):
    root = scratch_path(spark, "store")
    store.load(rows(spark, *[(k, "old") for k in range(50)]), root, "t", ["id"], buckets=4)
    old = held(spark, root)
    whole = getattr(store, step)

    def stopping(*args):
        if done:
            whole(*args)
        raise RuntimeError("stopped")
    with monkeypatch.context() as m:
        m.setattr(store, step, stopping)
        with pytest.raises(RuntimeError, match="stopped"):
            store.load(rows(spark, (7, "new"), (99, "new")), root, "t", ["id"])
    new = sorted([(k, v) for k, v in old if k != 7] + [(7, "new"), (99, "new")], key=str)
    assert held(spark, root) == (new if step == "_put" and done else old)
    assert store.load(rows(spark, (7, "new"), (99, "new")), root, "t", ["id"]) == 51
    assert held(spark, root) == new
    left = store.vacuum(spark, root, keep=1)  # of the folder that the stopped load has written, if it got so far
    assert left == int(step == "_put" or done) and held(spark, root) == new and len(store._versions(spark, root)) == 1


def test_of_two_jobs_from_one_version_the_second_fails(spark):
    root = scratch_path(spark, "store")
    store.load(rows(spark, (1, "a")), root, "t", ["id"])
    base, _ = store.current(spark, root)
    one, two = (store.stage_rows(rows(spark, (k, "x")), root, "t", ["id"]) for k in (2, 3))
    store.publish(spark, root, [one], base)
    with pytest.raises(RuntimeError, match="meanwhile"):
        store.publish(spark, root, [two], base)
    assert held(spark, root) == [(1, "a"), (2, "x")]


def test_a_daily_job_that_stops_leaves_every_table_as_it_was(spark, sf_dir, monkeypatch):
    from quarry.plans import fixtures as fx
    from quarry.plans.bind_jobs import daily_sources
    valid = fx.table(spark, sf_dir, "employees_raw").filter("coalesce(salary, '') not like '-%'")
    sources, warehouse = daily_sources(spark, sf_dir, valid)
    jobs.daily_job(spark, sources, warehouse, fx.AS_OF)
    version, before = store.current(spark, warehouse)
    assert version == 1 and set(jobs.DAILY_KEYS) < set(before)
    whole, calls = store.stage_rows, []

    def stopping(*args, **kwargs):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("stopped")
        return whole(*args, **kwargs)
    with monkeypatch.context() as m:
        m.setattr(store, "stage_rows", stopping)
        with pytest.raises(RuntimeError, match="stopped"):
            jobs.daily_job(spark, sources, warehouse, fx.AS_OF)
    assert store.current(spark, warehouse) == (1, before)
    jobs.daily_job(spark, sources, warehouse, fx.AS_OF)  # the same rows again
    assert {n: sum(e["rows"].values()) for n, e in store.current(spark, warehouse)[1].items()} == {
        n: sum(e["rows"].values()) for n, e in before.items()}


def test_a_cache_of_encodings_fills_and_encodes_each_text_once(spark):
    root = scratch_path(spark, "cache")
    texts = [f"text number {k}" for k in range(40)] + ["", None, "text number 1"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    sent = []

    def encoder(todo):
        sent.append(sorted(r["text"] for r in todo.collect()))
        return doc.hashing_encoder(8)(todo)
    first = doc.encode_cached(df, "doc_id", "text", root, encoder)
    assert first.fresh == 41 and first.rows.count() == len(texts) and len(sent[0]) == 41
    assert doc.encode_cached(df, "doc_id", "text", root, encoder).fresh == 0 and sent[1] == []
    more = df.unionByName(spark.createDataFrame([(100 + k, f"new {k}") for k in range(4)], df.schema))
    third = doc.encode_cached(more, "doc_id", "text", root, encoder)
    assert third.fresh == 4 and sent[2] == [f"new {k}" for k in range(4)]
    got = {r["doc_id"]: r["embedding"] for r in third.rows.collect()}
    none = spark.createDataFrame([], "text_hash string, embedding array<float>")
    want = {r["doc_id"]: r["embedding"] for r in doc.encode_once(more, "doc_id", "text", none, doc.hashing_encoder(8)).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want if k != 41) and got[41] is None


def test_routed_rows_get_the_answer_of_their_job(spark):
    df = spark.createDataFrame([(1, "hr"), (2, "fin"), (3, "odd"), (4, None), (None, "hr"), (1, "hr")], "id long, route string")
    ran = []

    def skill(name, only=None):
        def run(own):
            ran.append(name)
            return own.filter("id = 2" if only else "true").select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("answer"))
        return run
    registry = {"hr": "h", "fin": "f", "general": "g"}
    got = jobs.invoke(df, "route", registry, {"h": skill("h"), "f": skill("f"), "g": skill("g", True)}, "id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "h", "h1"), (1, "h", "h1"), (2, "f", "f2"), (3, "g", None), (4, "g", None), (None, "h", None)]))
    assert sorted(ran) == ["f", "g", "h"]
    assert jobs.invoke(df.limit(0), "route", registry, {"h": skill("h"), "f": skill("f"), "g": skill("g")}, "id").count() == 0

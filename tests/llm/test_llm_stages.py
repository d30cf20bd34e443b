"""Every stage of the pipeline on odd documents: nulls in every column, empty, blank and very long
texts, repeated rows and ids, ties, extra columns whose names clash with internal ones, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import materialise

EXTRA = ["component_id", "root", "score", "n_hit", "hit_spans", "secret_spans_", "start", "value", "__toxicity", "__text", "__row_hash", "a.b", "length"]
LONG = "some ordinary words in a line " * 20_000
ROWS = [(1, "plain text of a document", "en", "s", 24), (1, "plain text of a document", "en", "s", 24), (1, "another text under the same id", "en", "s", 30),
        (None, "text without an id", "en", "s", 18), (None, None, None, None, None), (2, None, "en", None, None), (3, "", None, "s", 0), (4, " \n\t", "en", "s", 3),
        (5, LONG, "en", "s", len(LONG)), (6, LONG, "en", "t", len(LONG)), (7, "token = 'abcdefghij' é", "en", "s", 22),
        (8, "日本語 текст ́ 🙂", "xx", "s", None), (9, "PLAIN text OF a document", "en", "s", 24)]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(EXTRA):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return materialise(docs, "odd-documents")


def run_stage(spark, name, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_and_extra_values_stay(spark, sf_dir, odd, name):
    out = run_stage(spark, name, odd, sf_dir)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    for r in out.collect():
        assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in EXTRA)
    empty = run_stage(spark, name, odd.limit(0), sf_dir)
    assert empty.count() == 0 and empty.columns == odd.columns


def test_toxicity_keeps_clean_documents(spark, sf_dir, odd):
    out = run_stage(spark, "toxicity", odd, sf_dir)
    assert sorted(map(key, out.collect())) == sorted(map(key, odd.collect()))


def test_simhash_keeps_one_of_each_group(spark, sf_dir, odd):
    got = sorted((r["doc_id"], (r["text"] or "")[:10]) for r in run_stage(spark, "simhash_near_dedup", odd, sf_dir).collect() if r["doc_id"] is not None)
    # null, empty and blank texts are one group (fingerprint 0), of which id 2 comes first; of the long ones, id 5
    assert got == [(1, "another te"), (1, "plain text"), (2, ""), (5, "some ordin"), (7, "token = 'a"), (8, "日本語 текст ")]
    assert run_stage(spark, "simhash_near_dedup", odd, sf_dir).filter("doc_id is null").count() == 1


def test_decontamination_takes_only_contaminated(spark, sf_dir, odd):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    more = odd.unionByName(odd.filter("doc_id = 1").limit(1).withColumn("text", F.lit(item)).withColumn("doc_id", F.lit(50).cast("long")))
    got = run_stage(spark, "benchmark_decontamination", more, sf_dir)
    assert sorted(map(key, got.collect())) == sorted(map(key, odd.collect()))


def test_secrets_are_masked_and_nothing_else(spark, sf_dir, odd):
    got = sorted(run_stage(spark, "secret_scan", odd, sf_dir).collect(), key=key)
    want = sorted(odd.collect(), key=key)
    for g, w in zip(got, want):
        if w["doc_id"] == 7:
            assert (g["text"], g["n_chars"]) == ("[assign]' é", 11)
        else:
            assert (g["text"], g["n_chars"]) == (w["text"], w["n_chars"])


def test_packing_packs_every_row(spark, sf_dir, odd):
    rows = run_stage(spark, "best_fit_packing", odd, sf_dir).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    assert run_stage(spark, "best_fit_packing", odd.limit(0), sf_dir).count() == 0

"""The registered queries without an oracle, on a whole small table set, against brute force."""

import html
import re
import struct
import zlib

import pytest
import xxhash

from quarry.llm import queries as Q
from quarry.llm import shard_table, token_count
from test_llm_text_operators import check_packing, plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op5_scores_every_document_and_learns_only_outside_the_held_out_fold(spark, sf_dir, docs):
    rows = Q.op5(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    # the same scores again, and from labels whose held-out part says the opposite
    again = {r["doc_id"]: r["score"] for r in Q.op5(spark, sf_dir).collect()}
    assert all(r["score"] == pytest.approx(again[r["doc_id"]], abs=1e-9) for r in rows)
    from pyspark.sql import functions as F

    from quarry.llm import toxicity
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.train(table, turned)).collect()}
    assert all(r["score"] == pytest.approx(other[r["doc_id"]], abs=1e-9) for r in rows)


def test_op6_places_every_document(spark, sf_dir, docs):
    rows = Q.op6(spark, sf_dir).collect()
    table = shard_table.fill_table(Q.SHARDS)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["shard"] == Q.SHARDS[table[r["slot"]]] for r in rows)
    # the hash of a long is that of its eight bytes, taken as signed
    digest = {r["doc_id"]: xxhash.xxh64(struct.pack("<q", r["doc_id"]), seed=42).intdigest() for r in rows}
    assert all(r["slot"] == (h - (h >> 63 << 64)) % shard_table.TABLE_SIZE for r in rows for h in [digest[r["doc_id"]]])


def test_op7_matches_all_pairs(spark, sf_dir, docs):
    ids = sorted(docs)
    fps = [plain_fingerprint(docs[i]) for i in ids]
    links = [(i, j) for j in range(len(ids)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    roots = plain_components(len(ids), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op7(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[k]:016x}", ids[roots[k]]) for k, i in enumerate(ids)}


def test_op8_matches_the_article_element(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}

    def article(page):
        inside = re.search("<article>(.*?)</article>", page, re.S)[1]
        blocks = (html.unescape(re.sub("<[^>]+>", " ", b)) for b in re.split("</?(?:p|h1)>", inside))
        return "\n".join(" ".join(b.split()) for b in blocks if b.split())

    got = {r["page_id"]: r for r in Q.op8(spark, sf_dir).collect()}
    assert sorted(got) == sorted(pages)
    for i, r in got.items():
        assert (r["url"], r["text"], r["n_chars"]) == (pages[i]["url"], article(pages[i]["html"]), len(r["text"]))


def test_op9_matches_each_word_on_its_own(spark, sf_dir, docs):
    vocab = token_count.Vocabulary(Q.tokenizer_path("piece_bpe_32k.model"))
    known = {}

    def tokens(w):
        if w not in known:
            known[w] = vocab.count_all([token_count.MARK + w])[token_count.MARK + w]
        return known[w]

    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in Q.op9(spark, sf_dir).collect()}
    assert got == {i: (len((t or "").split()), sum(map(tokens, (t or "").split()))) for i, t in docs.items()}


def test_op10_packs_every_document(spark, sf_dir, docs):
    order = {d: k for k, d in enumerate(sorted(docs))}
    rows = [{**r.asDict(), "doc_id": order[r["doc_id"]]} for r in Q.op10(spark, sf_dir).collect()]
    bins = check_packing(rows, [docs[d] for d in sorted(docs)])
    assert bins >= sum(r["length"] for r in rows) / 2048

"""URL filter, shard table, embedding index, toxicity, HTML extraction and the pipeline."""

import math
import platform
import random
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, duck
from quarry.llm import common, decontaminate, html_wrappers, multi_index, packing, secret_scan, shard_table, simhash, toxicity, url_filter
from quarry.llm import queries as Q
from quarry.llm.components import components


# --- registered queries -------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    problems, _ = compare(Q.QUERIES[name](spark, sf), duck(sf), Q.ORACLES[name])
    assert not problems, problems


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in Q.QUERIES) == list(range(1, 14))


# --- URL filter ---------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.B.ORG/x?y#z", "https://example.org/es/1", "https://example.org/es", "http://m.example.org/en/12",
        "x://y://com/fr/", "http://u:p@h.com:80/fr/2", "http://xcom/fr/", "http://org", "http://org?/", "http://É.ORG/é\n/x", "http://a.co.uk/", "http://b.net/en/1"]


def plain_url(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_urls_match_brute_force(spark):
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    got = url_filter.judge_urls(d, Q.URL_RULES).orderBy("page_id").collect()
    assert len(got) == 2 * len(URLS)
    for r, u in zip(got, URLS + URLS):
        host, path, rule, verdict = plain_url(u, Q.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert verdict is None or r["verdict"] == verdict
    assert url_filter.judge_urls(d.limit(0), Q.URL_RULES).count() == 0


def test_hosts_borrow_from_their_domain_and_suffix(spark):
    rows = [("bad.example.net", 1)] * 200 + [("new.example.net", None)] + [("good.net", 0)] * 300 + [("one.good.net", 1)] + [("fresh.org", None)]
    d = spark.createDataFrame([(i, f"http://{h}/", y) for i, (h, y) in enumerate(rows)], "page_id long, url string, bad int")
    got = {r["host"]: r for r in url_filter.judge_urls(d, [], outcome_col="bad").collect()}
    assert got["bad.example.net"]["verdict"] == "block" and got["good.net"]["verdict"] == "allow"
    assert got["one.good.net"]["verdict"] == "allow"  # one bad page does not make a bad host
    assert got["new.example.net"]["bad_mean"] > 0.5 > got["one.good.net"]["bad_mean"]
    assert 0 < got["fresh.org"]["bad_mean"] < 1 and got["fresh.org"]["verdict"] == "allow"
    assert got["bad.example.net"]["bad_bound"] < got["bad.example.net"]["bad_mean"]


def test_no_outcomes_block_nothing(spark):
    d = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    r = url_filter.judge_urls(d, []).first()
    assert (r["rule"], r["verdict"], r["n_outcomes"]) == (None, "allow", 0)


# --- shard table --------------------------------------------------------------------------------

def plain_table(names, size):
    """Slots by simulating the turns on explicit permutations."""
    names = sorted(set(names))
    orders = []
    for n in names:
        start, stride = shard_table.preference(n, size)
        orders.append([(start + j * stride) % size for j in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    return [owner[s] for s in range(size)]


def test_table_matches_simulation_and_is_even():
    names = [f"s{i}" for i in range(7)]
    table = shard_table.fill_table(names + ["s3"], 251)
    assert table == plain_table(names, 251) == shard_table.fill_table(names[::-1], 251)
    n = np.bincount(table)
    assert n.max() - n.min() <= 1
    heavy = np.bincount(shard_table.fill_table(names, 251, {"s0": 3}))
    assert heavy[0] > 2.5 * heavy[1]
    assert 0 not in shard_table.fill_table(names, 251, {"s0": 0})
    for weights in ({n: 0 for n in names}, {"s0": -1}):
        with pytest.raises(ValueError):
            shard_table.fill_table(names, 251, weights)
    for bad in ([], names):
        with pytest.raises(ValueError):
            shard_table.fill_table(bad, 250)


def test_leaving_shard_hardly_moves_others():
    names = [f"s{i:02d}" for i in range(20)]
    before, after = shard_table.fill_table(names, 65537), shard_table.fill_table(names[:-1], 65537)
    moved = sum(a != b for a, b in zip(before, after) if b != 19 and a != 19)
    assert moved < 0.06 * 65537


def test_placement(spark):
    d = spark.createDataFrame([(i % 50 if i else None, "x", "y") for i in range(200)], "doc_id long, slot string, `a.b` string")
    names = [f"s{i}" for i in range(5)]
    got = shard_table.place(d, ["doc_id"], names, 251)
    table = shard_table.fill_table(names, 251)
    assert got.columns == ["doc_id", "a.b", "slot", "shard"] and got.count() == 200
    assert all(r["shard"] == sorted(names)[table[r["slot"]]] for r in got.collect())
    assert got.select("doc_id", "shard").distinct().count() == got.select("doc_id").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
    assert shard_table.place(d.limit(0), ["doc_id"], names, 251).count() == 0


# --- components ---------------------------------------------------------------------------------

def plain_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(-100, 300)],
             "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "none": []}[shape]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links + links[:3] + [(None, 1)], "a long, b long").repartition(5), "a", "b")
    nodes = {x for e in links for x in e}
    want = {n: r for n, r in plain_roots(nodes, links).items() if n != r}
    assert {r["node"]: r["root"] for r in got.collect()} == want and got.count() == len(want)


# --- embeddings ---------------------------------------------------------------------------------

def plain_neighbours(vectors, similarity=0.95):
    def unit(v):
        if v is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        return x / np.linalg.norm(x)
    u = [unit(v) for v in vectors]
    return [(i, j) for j in range(len(u)) for i in range(j) if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j])
            and float(u[i] @ u[j]) >= similarity]


def embedding_case():
    rng = np.random.default_rng(4)
    out = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0], [2.0], [-1.0]]
    for _ in range(40):
        c = rng.standard_normal(8)
        for k in range(rng.integers(1, 8)):
            out.append([float(x) for x in np.float32(c + (0.12 * k) * rng.standard_normal(8))])
    out += [out[-1], [2 * x for x in out[-1]], out[20], out[20]]
    return out


def test_embedding_links_match_brute_force(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 4), ("BLOCK_ROWS", 8), ("CHUNK_ROWS", 16)):
        monkeypatch.setattr(multi_index, name, value)
    vectors = embedding_case()
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("cls", F.lit(1))
    got = multi_index.near_duplicates(d, recall=1.0).orderBy("id").collect()
    links = plain_neighbours(vectors)
    n = np.bincount([i for e in links for i in e], minlength=len(vectors))
    assert sum(r["n_links"] for r in got) >= 0.98 * n.sum() and all(r["n_links"] <= k for r, k in zip(got, n))
    roots = plain_roots(range(len(vectors)), links)
    agree = sum(r["component_id"] == roots[i] and r["kept"] == (roots[i] == i) for i, r in enumerate(got))
    assert len(got) == len(vectors) and agree >= 0.97 * len(vectors)


def test_embedding_edges(spark):
    v = [1.0, 0.0]
    d = spark.createDataFrame([(3, v), (3, v), (None, v), (2, [0.0, 1.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(((r["id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in multi_index.near_duplicates(d).collect()))
    assert got == [(-1, 0, -1, False), (-1, 2, 3, False), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True)]
    assert multi_index.near_duplicates(d.limit(0)).count() == 0


def test_recall_on_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = Q.op4(spark, sf).orderBy("vec_id").toPandas()["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_traversal_is_in_order_and_complete_to_its_depth():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ix = multi_index.Index(x, 500 * multi_index.CELL_ROWS // 8, 0.9, 0.99)
    d1, d2 = ix.spread(x[:20])
    for a, b in zip(d1, d2):
        cells = ix.visits(a, b)
        total = (a[:, None] + b[None, :]).ravel()
        assert [total[c] for c in cells] == sorted(total[c] for c in cells)
        assert sorted(cells) == sorted(np.flatnonzero(total <= total.min() + ix.depth).tolist())


# --- toxicity -----------------------------------------------------------------------------------

def toxic_case(n=400):
    rng = random.Random(8)
    syllables = "ka lo mi ner sta dru pe vo zin ta ru".split()
    say = lambda k: ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(k)]
    texts, labels = [], []
    for i in range(n):
        words, bad = say(rng.randrange(20, 200)), i % 4 == 0
        if bad:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["blorgh", "fnix" + rng.choice(syllables)])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_held_out_accuracy_and_whole_texts(spark):
    texts, labels = toxic_case()
    clean = texts[1]
    extra = {1000: None, 1001: "", 1002: clean * 200 + " blorgh blorgh " + clean * 200, 1003: clean * 400}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + list(extra.items()) + [(5, texts[5]), (None, clean)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y, None) for i, y in enumerate(labels)] + [(7, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs.withColumn("score", F.lit("x")), toxicity.train(docs, lab)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i] >= 0.5) == bool(labels[i]) for i in held]) >= 0.95
    assert by[1002] >= 0.5 > by[1003] and by[1000] == by[1001] < 0.5
    kept = toxicity.remove_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.remove_toxic(docs, none).count() == 2
    assert toxicity.remove_toxic(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.remove_toxic(docs, one).count() == 2


def plain_beginnings(text):
    out = []
    for w in (text.lower() + " ").replace("\n", " ").split(" "):
        data = w.encode() + b" "
        if w:
            out += [int.from_bytes(b" " + data[:i + 1], "big") for i in range(min(len(data), toxicity.REACH))]
    return out


def test_beginnings_of_words():
    for text in ("", " ", "a", "The  quick\nbrown é日本語 fox", "x" * 30 + " y"):
        key, part, word = toxicity.grams(toxicity.slices(text))
        assert key.tolist() == plain_beginnings(text) and len(set(word.tolist())) == len(text.split())
    parts = toxicity.slices("ab cd") + toxicity.slices("ef")
    key, part, _ = toxicity.grams(parts)
    assert key.tolist() == plain_beginnings("ab cd") + plain_beginnings("ef") and part.tolist() == [0] * 6 + [1] * 3


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    text = "words of é some length " * 30 + "z" * 200 + " end"
    parts = toxicity.slices(text)
    assert len(parts) > 10 and b"".join(d for _, d in parts) == text.encode() + b" "
    assert [k for owner, group in toxicity.chunked([text]) for k in toxicity.grams(group)[0].tolist()] == plain_beginnings(text)


def test_model_follows_its_definition(spark):
    text = "the cat sat on the mat and the bat sat too then "
    key, _, _ = toxicity.grams(toxicity.slices(text))
    rows = [(int(k), int(c), max(int(c) - 1, 0), 1) for k, c in zip(*np.unique(key, return_counts=True))]
    table = spark.createDataFrame(rows, "g long, n long, n_ord long, n_tox long")
    p = {r["g"]: r["p"] for r in toxicity.continuation_model(table).collect()}
    assert set(p) == {k & 0xFFFFFFFF for k in key.tolist()}
    by_history = {}
    for g, x in p.items():
        by_history[g >> 8] = by_history.get(g >> 8, 0) + x
    assert all(0 < s <= 1 + 1e-9 for s in by_history.values())
    got = {x["g"]: x["ratio"] for x in toxicity.ratios(table).collect()}

    def prob(r, k, low):
        same = [x for x in rows if x[0] >> 8 == r[0] >> 8]
        seen = sum(x[k] for x in same)
        return (max(r[k] - 1.5, 0) + sum(min(x[k], 1.5) for x in same) * low) / seen if seen else low

    for r in rows:
        everywhere = prob(r, 1, p[r[0] & 0xFFFFFFFF])
        assert got[r[0]] == pytest.approx(math.log(prob(r, 3, everywhere)) - math.log(prob(r, 2, everywhere)))


def test_all_labels_outside_the_held_out_fold_are_taken(spark):
    n = 700_000
    got = toxicity.training_labels(spark.range(n).withColumn("toxic", F.lit(1)), "id", "toxic").toArrow()
    folds = [zlib.crc32(str(i).encode()) % 5 for i in range(n)]
    assert len(got) == n - folds.count(0) > 500_000
    assert all(folds[i] and v == 2 + (folds[i] < 4) for i, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def test_curve_gets_all_rows_kept_for_it(spark, monkeypatch):
    docs = spark.range(270_000).select("id", F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit(0).alias("toxic"))
    fitted = []
    monkeypatch.setattr(toxicity, "fit_curve", lambda rows, share: fitted.append((rows.agg(F.sum("n")).first()[0], share())))
    toxicity.train(docs, docs, "id", "text", "id", "toxic")
    assert fitted == [(sum(zlib.crc32(str(i).encode()) % 5 == 4 for i in range(270_000)), 0.0)] and fitted[0][0] > 50_000


def test_curve_over_parts_is_that_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    y = (rng.random(4_000) < 0.3).astype(float)
    x = np.round(rng.normal(size=(4_000, toxicity.FEATURES)) + 0.7 * y[:, None] * np.arange(toxicity.FEATURES), 1)
    x[:, 5], x[:1_500], y[:1_500] = 2.5, x[0], y[0]  # a constant, and a row that is there very often
    rows = spark.createDataFrame([(a, b) for a, b in zip(y.tolist(), x.tolist())], "label double, features array<double>")
    rows = rows.groupBy("label", "features").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    monkeypatch.setattr(toxicity, "FIT_ROWS", 300)
    for _ in range(2):
        parts.append(toxicity.fit_curve(rows.repartition(7), None))
    monkeypatch.undo()
    whole = toxicity.fit_curve(rows, None)
    assert all(np.array_equal(parts[0][k], parts[1][k]) and np.allclose(parts[0][k], whole[k], atol=1e-9) for k in whole)

    # against its definition on the single rows
    low, high = np.quantile(x[:, 3], [0.01, 0.99])
    x[:, 3] = np.clip(x[:, 3], low, high)
    assert (whole["low"][3], whole["high"][3]) == pytest.approx((low, high))
    assert whole["mean"] == pytest.approx(x.mean(axis=0)) and whole["scale"] == pytest.approx(x.std(axis=0), abs=1e-8)
    z = np.column_stack([np.ones(len(x)), (x - whole["mean"]) / whole["scale"]])
    slope = z.T @ (y - 1 / (1 + np.exp(-z @ whole["w"]))) - np.diag([1e-6] + [1e-2] * toxicity.FEATURES) @ whole["w"]
    assert np.abs(slope).max() < 1e-5
    # a class is missing
    assert toxicity.fit_curve(rows.filter("label = 0"), lambda: 0.25)["w"][0] == pytest.approx(math.log(1 / 3))


def test_labels_are_looked_up_in_pieces_or_joined(spark, monkeypatch):
    texts, labels = toxic_case(200)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[4]), (-7, texts[8]), (10_000, None)]
    marks = [(i, y) for i, y in enumerate(labels) if i % 3] + [(4, 0), (4, 1), (-7, 1), (None, 1), (8, None), (1 << 40, 1)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    scores = lambda docs, lab: [r["score"] for r in toxicity.score(docs, toxicity.train(docs, lab)).orderBy("doc_id", "text").collect()]
    want = scores(docs, lab)
    assert min(want) < 0.5 < max(want)
    monkeypatch.setattr(toxicity, "PIECE_KEYS", 40)
    known = toxicity.training_labels(lab, "doc_id", "toxic")
    tagged, pieces, _ = toxicity.with_labels(docs, known, "doc_id", "text")
    assert len(pieces.parts) > 2

    # every row has the label of its id, and no piece is taken more than once for a run
    value = {r["label_id"]: r["value"] for r in known.collect()}
    taken = []
    find = lambda keys: taken.append(len(keys)) or toxicity.Pieces.find(pieces, keys)
    counting = type("Counting", (), {"find": staticmethod(find)})
    got = [(i, v) for t, x in toxicity._valued(iter(tagged.toArrow().to_batches(max_chunksize=9)), counting) for i, v in zip(t.column(1).to_pylist(), x.tolist())]
    assert taken == [len(rows)] and [i for i, _ in got] == [i for i, _ in rows]
    assert all(v == value[i] if i in value else math.isnan(v) for i, v in got)
    monkeypatch.setattr(toxicity, "PIECE_KEYS", 3_000)
    assert scores(docs, lab) == pytest.approx(want, abs=1e-9)
    monkeypatch.undo()

    named = lambda t: t.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert toxicity.with_labels(named(docs), toxicity.training_labels(named(lab), "doc_id", "toxic"), "doc_id", "text")[1] is None
    assert sorted(scores(named(docs), named(lab))) == pytest.approx(sorted(want), abs=1e-9)
    assert scores(docs, lab.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))) == pytest.approx(want, abs=1e-9)


def test_slots_agree_with_sql(spark):
    g = np.array([0x2061, 0x20616263, 0x2061626364656667, 0x207A207A207A207A], dtype=np.uint64)
    d = spark.createDataFrame([(int(x),) for x in g], "g long").select(F.pmod(F.hash("g"), F.lit(1 << toxicity.SLOT_BITS)).alias("s"))
    assert toxicity.slots(g).tolist() == [r["s"] for r in d.collect()]


def test_scoring_looks_up_exact_ngrams(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(4_000))
    key, _, _ = toxicity.grams(toxicity.slices(text))
    u, c = np.unique(key, return_counts=True)
    counts = [(int(k), int(n), rng.randrange(0, int(n) + 1)) for k, n in zip(u, c)]
    table = spark.createDataFrame([(k, n, a, rng.randrange(0, n - a + 1)) for k, n, a in counts], "g long, n long, n_ord long, n_tox long")
    want = {r["g"]: r["ratio"] for r in toxicity.ratios(table).collect()}
    monkeypatch.setattr(toxicity, "PIECE_KEYS", 300)
    pieces = toxicity.Pieces(toxicity.scoring_table(table), "test-ratios")
    assert len(pieces.parts) > 2 and len(want) > 1_000
    run = lambda ks: toxicity.byte_ratios(pieces, np.array(ks, dtype=np.uint64)).tolist()
    got = spark.sparkContext.parallelize([sorted(want)], 1).map(run).first()
    assert got == pytest.approx([want[k] for k in sorted(want)], abs=1e-5)


class CountingPieces:
    """A table of ratios that counts how often a piece is taken."""

    def __init__(self, keys, n):
        self.taken, self.n, self.keys = 0, n, np.unique(np.array(keys, dtype=np.uint64))

    def find(self, keys):
        self.taken += self.n
        there = np.isin(keys, self.keys)
        return np.where(there, (keys % np.uint64(7)).astype(float) - 3, 0.0), there


def test_pieces_are_taken_once_for_many_texts():
    texts = [f"some words here and number{k} again\nwith more of them" for k in range(300)] + [None, "", "x"]
    key = np.concatenate([toxicity.grams(toxicity.slices(t), whole=True)[0] for t in texts])
    few, many = [(CountingPieces(key, n), CountingPieces([], n)) for n in (1, 30)]
    got = toxicity.features(texts, few)
    assert (few[0].taken, few[1].taken) == (1, 1)
    assert (toxicity.features(texts, many) == got).all() and many[0].taken == 30
    # words that are remembered need no piece; each text on its own gives the same
    memory = toxicity.WordRatios(few[0])
    alone = np.vstack([toxicity.features([t], few, memory) for t in texts])
    assert np.allclose(alone, got)
    before = few[0].taken
    toxicity.features(texts, few, memory)
    assert few[0].taken == before
    runs = list(toxicity.together(iter([pd.Series(["ab", None]), pd.Series(["cde"]), pd.Series([], dtype=str), pd.Series(["f"])]), 4))
    assert [[len(s) for s in r] for r in runs] == [[2, 1], [0, 1]]


def test_memory_of_scoring_does_not_grow_with_the_rows_of_a_batch(monkeypatch):
    class Nothing:
        def find(self, keys):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)

    table = Nothing(), Nothing()
    monkeypatch.setattr(toxicity, "add_columns", lambda df, fields, rows, needs: rows)
    monkeypatch.setattr(toxicity, "LOOKAHEAD", 1 << 19)
    rows = toxicity.with_features(None, "text", table)

    def peak(texts):
        tracemalloc.start()
        rows(texts)
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    rnd, vocabulary = random.Random(11), [f"w{k}rd{k % 89}" for k in range(5_000)]
    texts = [" ".join(rnd.choices(vocabulary, k=500)) for _ in range(600)]
    assert peak(texts) < 1.5 * peak(texts[:100])

    # each text once and in order, with the features it has alone
    runs, real = [], toxicity.features
    monkeypatch.setattr(toxicity, "LOOKAHEAD", 100)
    monkeypatch.setattr(toxicity, "features", lambda texts, *more: runs.append(list(texts)) or real(texts, *more))
    some = ["a b c " * 10, None, "", "d e " * 20, "f" * 300, "g h", "i"] * 3
    got, = rows(some)
    assert [t for r in runs for t in r] == some and np.array_equal(got, np.vstack([real([t], table) for t in some]))
    assert all(sum(len(t or "") for t in r) <= 100 or len([t for t in r if t]) == 1 for r in runs) and len(runs) > 6
    assert [len(s) for s in toxicity.shared_out(pd.Series(["abc", None, "d", "efghi", "j"]), 4)] == [3, 1, 1]
    assert [len(s) for s in toxicity.shared_out(pd.Series([], dtype=str), 4)] == [0]


def test_counting_holds_and_sends_bounded_parts():
    rng, names = np.random.default_rng(5), ["g", "n", "n_ord", "n_tox"]
    groups = [np.unique(np.r_[np.arange(1_000), rng.integers(0, 1 << 62, 50_000)]).astype(np.uint64) for _ in range(40)]

    def found():
        for key in groups:
            yield [key, np.full(len(key), 3), np.full(len(key), 2), np.full(len(key), 1)]

    tracemalloc.start()
    rows = total = 0
    often = np.zeros(1_000, dtype=np.int64)
    for b in toxicity._counting(found(), names):
        assert b.num_rows <= toxicity.EMIT_ROWS
        g, n, n_ord, n_tox = (c.to_numpy() for c in b.columns)
        assert (2 * n == 3 * n_ord).all() and (n == 3 * n_tox).all()
        rows, total = rows + b.num_rows, total + int(n.sum())
        often += np.bincount(g[g < 1_000], weights=n[g < 1_000], minlength=1_000).astype(np.int64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3 * sum(map(len, groups)) and (often == 3 * len(groups)).all() and rows < sum(map(len, groups))
    assert peak < 50 << 20
    assert list(toxicity._counting(iter([]), names)) == []


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="others decide themselves what they keep")
def test_freed_memory_of_a_task_goes_back():
    def own():
        return sum(int(x) for x in re.findall(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())) / 1024

    held = [b"x" * 100_000 for _ in range(3_000)]
    full, last = own(), held[-1]  # the last one keeps the others' room from being cut off at the end
    del held
    common.give_back()
    assert own() < full - 150 and len(last) == 100_000


def test_words_have_the_ngrams_of_their_text(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = ["".join(rnd.choice(list("abcdefghij \n\té"), p=[0.07] * 12 + [0.08] * 2, size=400)) for _ in range(5)] + ["", " ", "x" * 300, "a\nb" * 50]
    for chunk in (1 << 19, 60):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for owner, parts in toxicity.chunked(texts):
            w = toxicity.Words(parts)
            want = toxicity.grams(parts, whole=True)[0]
            got, word, _ = toxicity._ngrams(*w.spelled(np.arange(len(w.hash))), True)
            assert sorted(got.tolist()) == sorted(want.tolist())
            own = [tuple(got[word == k].tolist()) for k in range(len(w.hash))]
            assert len(set(own)) == len(set(w.hash.tolist())) == len(set(zip(own, w.hash.tolist())))


def test_every_byte_and_every_pair_is_read(monkeypatch):
    def plain(text):
        out = []
        for w in text.split():
            data = b" " + w.encode() + b" "
            out += [int.from_bytes(data[max(0, i - 7):i + 1], "big") for i in range(1, len(data))]
        return out

    def plain_pairs(text):
        w = text.split()
        return list(zip(w, w[1:]))

    for chunk in (1 << 19, 50, 64):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for text in ("", "a", "short and verylongwordhere é日本語日本語日本語 x" * 9, "z" * 200 + " end\nof " + "y" * 49 + "\n" + "q" * 50 + " q"):
            assert [k for _, g in toxicity.chunked([text]) for k in toxicity.grams(g, whole=True)[0].tolist()] == plain(text)
            got = [p for a, b, _ in toxicity.pairs(toxicity.chunked([text])) for p in zip(a.tolist(), b.tolist())]
            names = dict(zip([x for p in got for x in p], [x for p in plain_pairs(text) for x in p]))
            assert [tuple(names[x] for x in p) for p in got] == plain_pairs(text) and len(set(names.values())) == len(names)
    many = ["a b c", "", "c d", "e", "x" * 120 + " y z"]
    docs = [d for _, _, doc in toxicity.pairs(toxicity.chunked(many)) for d in doc.tolist()]
    assert docs == [0, 0, 2, 4, 4]


def test_ends_of_long_words_and_expressions_are_judged(spark):
    rng = random.Random(5)
    words = ["extraord" + x for x in ("inarily", "inary", "onnance", "eal")] + ["vile", "dog", "small", "green", "house"]
    rows = []
    for i in range(600):
        bad, kind = i % 3 == 0, i % 2
        text = [rng.choice(words) for _ in range(40)]
        if kind:
            # "vile dog" is toxic, "vile" and "dog" apart are not
            text = [w for w in text if w not in ("vile", "dog")] + (["vile", "dog"] if bad else rng.choice([["vile", "green", "dog"], ["dog", "vile"]]))
        else:
            text = [w for w in text if w not in ("vile", "dog")] + (["extraordblorgh"] if bad else ["extraordinary"])
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), docs)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][2]) for i in held]) >= 0.95


# --- HTML ---------------------------------------------------------------------------------------

LAYOUT = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><div class="cookie-notice">We use cookies</div>
<header><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav></header>{ad}<article>{body}</article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice!</p></div></section><aside class="sidebar"><p>Also read</p></aside>
<form><label>mail</label><input></form><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_article_of_a_host(spark):
    rng = random.Random(6)
    rows, want = [], []
    for i in range(120):
        blocks = [f"Title {i} &lt;1&gt;"] + [f"Par {j}  of\n {i} caf&eacute;" for j in range(rng.randrange(0, 6))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br></p>", "<blockquote><p>{}</p></blockquote>"]).format(b) for b in blocks[1:])
        ad = rng.choice(["", '<div class="ad">Buy</div>', '<div class="ad">Buy</div><div class="ad">More</div>'])
        rows.append((i, f"http://h{i % 3}.net/{i}", LAYOUT.format(ad=ad, body=body)))
        want.append("\n".join([f"Title {i} <1>"] + [f"Par {j} of {i} café" for j in range(len(blocks) - 1)]))
    rows += [(120, None, None), (121, "http://h0.net/", ""), (122, "http://h0.net/", rows[0][2]), (123, "x", "just text"), (124, "http://h1.net/", "<p>cut &amp <b>of")]
    want += ["", "", want[0], "just text", "cut & of"]
    d = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, `a.b` string").withColumn("main_text", F.lit(0))
    got = html_wrappers.extract(d).orderBy("page_id").collect()
    assert [r["main_text"] for r in got] == want
    assert html_wrappers.extract(d).columns == ["page_id", "url", "a.b", "main_text"]
    assert html_wrappers.extract(d.limit(0)).count() == 0


def test_wrapper_of_two_pages():
    shape = lambda h: html_wrappers.structure(html_wrappers.parse(h))
    w = html_wrappers.infer([shape("<ul><li>a<li>b</ul><p>x</p>"), shape("<ul><li>a</ul><div>n</div><p>x</p><h2>t</h2><p>y</p><h2>t</h2><p>y</p>")])
    text = [["#", "1", []]]
    assert html_wrappers._shape(w)[2] == [["ul", "1", [["li", "+", text]]], ["div", "?", text],
                                          ["()", "*", [["p", "1", text], ["h2", "1", text]]], ["p", "1", text]]


def test_many_layouts_are_folded_in_groups(spark, monkeypatch):
    monkeypatch.setattr(html_wrappers, "GROUP", 4)
    rows = [(i, "http://h.net/", "<body>" + "".join(f"<div class=w{chr(97 + k)}x>s</div>" for k in range(6) if i >> k & 1) + "<article><p>text</p></article></body>")
            for i in range(64)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["main_text"] for r in html_wrappers.extract(d).collect()} == {"text"}
    assert html_wrappers.host_wrappers(d).count() == 1


def test_long_page_is_whole(spark):
    page = "<article>" + "<p>para graph</p>" * 20_000 + "</article>"
    d = spark.createDataFrame([(1, "http://h.net/", page)], "page_id long, url string, html string")
    assert html_wrappers.extract(d).first()["main_text"] == "\n".join(["para graph"] * 20_000)


def alone(page):
    return html_wrappers.texts(page, None)


def test_named_inline_elements_end_where_they_end(spark):
    page = '<article><h1>T</h1><p>One <span class="share">S</span> two.</p><p>Three</p></article>'
    d = spark.createDataFrame([(1, "http://h.net/", page)], "page_id long, url string, html string")
    assert html_wrappers.extract(d).first()["main_text"] == "T\nOne two.\nThree"
    assert alone('<article><p>foo<small class=ad>x</small>bar <a class="tag" href=x>t</a> <a class=tag>u</a>baz</p><p>end</article>') == ["foobar baz", "end"]
    assert alone("<article><p>One <span class=ad>a<span>b</span>c</span> two<p>Three <span class=ad>open<p>Four</article>") == ["One two", "Three", "Four"]
    assert alone("<article><div><a class=related><div>x</a> y</div></div><p>z</p></article>") == ["y", "z"]
    assert alone("<article>a <b>b</b> <span class=ad>n</span> c<p>d</p> e</article>") == ["a b c", "d", "e"]


def test_every_child_of_the_pattern_has_an_item():
    rng = random.Random(4)
    tags = ["h2", "p", "ul", "pre"]
    pages = ["h2 p h2 p ul pre h2 p h2 p ul pre p"] + [" ".join(rng.choice(tags) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    page = lambda s: "<article>" + "".join(f"<{t}>{'<li>' if t == 'ul' else ''}{t}{i}</{t}>" for i, t in enumerate(s.split())) + "</article>"
    want = lambda s: [f"{t}{i}" for i, t in enumerate(s.split())]
    merged = html_wrappers.mark(html_wrappers.infer([html_wrappers.structure(html_wrappers.parse(page(s))) for s in pages]))
    for s in pages:
        assert alone(page(s)) == want(s)
        assert html_wrappers.texts(page(s), merged) == want(s)
        for w in (merged, html_wrappers.mark(html_wrappers.structure(html_wrappers.parse(page(s))))):
            article, pattern = html_wrappers.parse(page(s)).kids[0], w[2][0][2]
            places = html_wrappers._places([k.key for k in article.kids], pattern, {})
            assert all(x is not None and x[0] == k.key for k, x in zip(article.kids, places))
    # lists at two places, with items of another make at each
    two = "<article><ul><li>a</ul><p>b</p><ul><li><pre>c</pre></ul><h2>d</h2><ul><li>e</ul></article>"
    assert alone(two) == ["a", "b", "c", "d", "e"]


def test_article_keeps_captions_formulas_fallbacks_and_linked_text(spark):
    page = ("<body><ul><li><a href=x>menu</a></ul><article><h1>T</h1><figure><img src=x><figcaption>Caption</figcaption></figure><p>Let <math><mi>x</mi><mo>=</mo>"
            "<mn>1</mn></math> be</p><noscript><p>No script</p></noscript><video src=v>Film</video><p><svg viewBox='0' />After</p><p><svg><title>no</title><g><text>Axis"
            "</text></g></svg> shown</p><p><a href=x>All linked</a></p><ul><li><a href=x>Ref 1</a><li><a href=x>Ref 2</a></ul><table><tr><td><a href=x>N</a></table>"
            "<object data=o><p>Object</p></object><p>Open <svg><path d=x>drawing<p>End</p></article><ul><li><a href=x>more</a></ul></body>")
    want = ["T", "Caption", "Let x=1 be", "No script", "Film", "After", "Axis shown", "All linked", "Ref 1", "Ref 2", "N", "Object", "Open drawing", "End"]
    d = spark.createDataFrame([(i, f"http://h{i % 2}.net/{i}", page) for i in range(4)], "page_id long, url string, html string")
    assert {r["main_text"] for r in html_wrappers.extract(d).collect()} == {"\n".join(want)}
    assert alone("<article><p>a</p><iframe src=x /><p>b</p><textarea><p>c</p></article>") == ["a", "b", "c"]
    # without an article, a list of links beside the paragraphs is still a menu
    assert alone("<body><ul><li><a href=x>menu</a></ul><p>text</p><p>more text</p></body>") == ["text", "more text"]


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage recomputed in plain Python on its input; the toxicity scores, a trained model's,
    are taken from the operator and their decisions checked."""
    from test_llm_text_operators import check_packing, plain_components, plain_fingerprint, plain_hits

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    own = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = [r for r in own if scores[r[0]] < 0.5]
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(len(rows), [(i, j) for j in range(len(rows)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = []
    for r in rows:
        n, hit, _ = plain_hits(r[1], items, 13)
        if not (hit and 20 * hit >= n):
            kept.append(r)
    assert 0 < len(kept) < len(rows) < len(own)
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf_dir)
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes, name
    masked = {r["doc_id"]: r for r in stage.collect()}
    assert sorted(masked) == sorted(r[0] for r in kept)
    spans = {r["doc_id"]: r["secret_spans"] for r in secret_scan.find_secrets(spark.createDataFrame(kept, docs.schema)).collect()}
    for r in kept:
        text, at = "", 0
        for s in spans[r[0]]:
            if s["start"] >= at:
                text += r[1][at:s["start"]] + f"[{secret_scan.KINDS[s['kind_no']]}]"
            at = max(at, s["end"])
        text += r[1][at:]
        assert masked[r[0]]["text"] == text and (masked[r[0]]["n_chars"] == len(text) or not spans[r[0]])
    out = corpus_pipeline.run(spark, sf_dir).collect()
    order = {d: i for i, d in enumerate(sorted(masked))}
    packed = [{**r.asDict(), "doc_id": order[r["doc_id"]]} for r in out]
    check_packing(packed, [masked[d]["text"] for d in sorted(masked)])


def test_pipeline_stages_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert all(m.__name__.startswith("quarry.llm.") for m in (simhash, decontaminate, packing)) and duckdb


def timed(page, most=10.0):
    start = time.process_time()
    got = html_wrappers.texts(page, None)
    assert time.process_time() - start < most
    return got


def test_deep_and_broken_pages_are_read_in_linear_time():
    deep = 100_000
    got = timed("<div>" * deep + "<p>low</p>" + "</div>" * deep + "<p>after</p>")
    assert got == ["low", "after"]
    assert timed("<article><h1>T</h1>" + "<div>a" * 2_000 + "</div>b" * 2_000 + "<p>end</p></article>")[-1] == "end"
    assert timed("<p>x</p>" + '<a "x ' * 170_000)[0] == "x"
    assert timed("<p>x</p>" + '<a "x ' * 170_000 + ">")[0] == "x"
    assert timed("<p>x</p>" + "<a 'x \"y " * 100_000 + '" >')[0] == "x"
    assert timed("<p>x</p>" + "<a " * 300_000 + '"')[0] == "x"
    assert timed("<p>x</p>" + "<title>" * 150_000)[0] == "x"
    assert timed("<p>x</p>" + "<svg>" + "<desc>" * 150_000)[0] == "x"
    assert timed("<p>x</p>" + "<" * 1_000_000)[0].startswith("x")
    assert timed("<p>x</p>" + "<a" * 500_000)[0].startswith("x")
    assert timed("<article>" + "".join(f"<p>{k}</p>" for k in range(20_000)) + "</article>") == [str(k) for k in range(20_000)]
    mixed = "".join(f"<div class=c{'abcdefgh'[k % 8]}{'xyz'[k % 3]}>{k}</div>" for k in range(20_000))
    assert timed("<article>" + mixed + "</article>") == [str(k) for k in range(20_000)]


def test_broken_pages_do_not_stop_the_others(spark):
    pages = [("http://a.org/1", "<div>" * 5_000 + "<p>deep</p>"), ("http://a.org/2", "<article><h1>T</h1><p>text</p></article>"),
             ("http://a.org/3", None), ("http://a.org/4", '<p>q</p><a "x ' + "y " * 50)]
    got = {r["url"]: r["main_text"] for r in html_wrappers.extract(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["http://a.org/1"] == "deep" and got["http://a.org/2"] == "T\ntext" and got["http://a.org/3"] == "" and got["http://a.org/4"].startswith("q")


def test_a_container_named_twice_is_judged_by_what_it_holds():
    article = "<div class='post sharing'><h1>T</h1><p>short</p></div>"
    notice = "<article><h1>A</h1><p>b</p><div class='content notice'>" + "<span>we use cookies</span> " * 300 + "</div></article>"
    assert html_wrappers.texts(f"<body><div class='menu'>m</div>{article}</body>", None) == ["T", "short"]
    assert html_wrappers.texts(notice, None) == ["A", "b"]

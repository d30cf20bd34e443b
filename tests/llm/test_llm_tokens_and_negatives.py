"""SentencePiece encoding, hard negatives and cross-tokenizer alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import cross_align, hard_negatives, piece_bpe
from quarry.llm import queries as Q

A_PATH, B_PATH = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " " * 300 + "abc" + " " * 37, "\x00\x01", "a▁b ▁▁", "<s>hi</s> <0x0A> <|endoftext|>", "a\tb\n\nc  d   e",
       "é漢字🙂�", "inging" * 50, "ing" * 1000, "ab" * 500, "=" * 1000, "日本語のテキスト" * 50, "aaaa" * 100, "1234567890" * 20, "same", "same"]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --- encoding and decoding -----------------------------------------------------------------------------

def test_ids_and_texts_are_those_of_the_library(pieces):
    rnd = random.Random(1)
    made = ["".join(rnd.choice("abeinghtr ▁  \n=-é日") for _ in range(rnd.randint(1, 150))) for _ in range(4000)]
    made += ["".join(rnd.choice(["the", "ing", "ation", "th", "e", " ", "er"]) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    texts = [t or "" for t in ODD] + made
    m = piece_bpe.PieceModel(B_PATH)
    ids, ends = m.encode(texts)
    want = pieces.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert m.decode(ids.astype(np.int64), ends) == [pieces.decode(x) for x in want]


def test_any_ids_decode_as_in_the_library(pieces):
    rnd = random.Random(2)
    m = piece_bpe.PieceModel(B_PATH)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, 3 + rnd.randrange(256), 3 + rnd.randrange(128, 256), rnd.randrange(32000), 28705, 259]) for _ in range(rnd.randint(0, 8))]
        assert m.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)])) == [pieces.decode(ids)]
    with pytest.raises(ValueError):
        m.decode(np.array([32000]), np.array([0, 1]))


def test_words_that_rounds_do_not_end_and_a_forgetful_memory(pieces, monkeypatch):
    texts = ["".join(random.Random(k).choices(["the", "ing", "ation", "er", "on"], k=400)) for k in range(20)] + [" " * 500, "x y z " * 50]
    monkeypatch.setattr(piece_bpe, "ROUNDS", 3)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 5)
    m = piece_bpe.PieceModel(B_PATH)
    for _ in range(2):
        for t in texts:
            assert m.encode([t])[0].tolist() == pieces.encode(t)


def test_pieces_of_odd_tables(spark, pieces):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "`doc.id` int, text string, PIECE_IDS string")
    got = piece_bpe.decode_pieces(piece_bpe.encode_pieces(df, B_PATH), B_PATH)
    assert got.columns == ["doc.id", "text", "piece_ids", "decoded"]
    for r in got.collect():
        ids = pieces.encode(r["text"] or "")
        assert r["piece_ids"] == ids and r["decoded"] == pieces.decode(ids)
    assert piece_bpe.encode_pieces(df.limit(0), B_PATH).count() == 0
    lists = spark.createDataFrame([([264, None, 287],), (None,), ([],)], "piece_ids array<int>")
    assert [r["decoded"] for r in piece_bpe.decode_pieces(lists, B_PATH).collect()] == [pieces.decode([264, 287]), "", ""]


def test_op11_on_a_whole_table(spark, sf_dir, texts, pieces):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in texts:
        ids = pieces.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(pieces.decode(ids))))
    assert sorted(map(tuple, Q.op11(spark, sf_dir).collect())) == sorted(want)


# --- hard negatives ------------------------------------------------------------------------------------

def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    """All pairs. ``rows``: (id, label, vector of floats, anchor)."""
    ok = [(i, l, [math.floor(256 * x) for x in v], a) for i, l, v, a in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, label, q, anchor) in enumerate(ok):
        if not anchor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), j, k, lab) for k, (j, lab, p, _) in enumerate(ok) if k != n and len(p) == len(q))
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [(t, m) for t, m, _, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s] if (low, high) == (50, 95) else []
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(fits[:negatives])]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, anchor boolean"


@pytest.mark.parametrize("block", [4, 50, 100_000])
def test_negatives_match_all_pairs(spark, block):
    rnd = np.random.default_rng(block)
    centre = rnd.normal(size=(6, 8))
    rows = [(int(k), int(k % 3), [float(np.float32(x)) for x in (centre[k % 6] + rnd.normal(size=8) * 0.6)], k % 5 == 0) for k in range(120)]
    rows += [(k, 2, [0.25] * 8, k % 50 == 0) for k in range(200, 260)]  # one vector, a third of all rows
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("anchor"), block_rows=block, anchor_rows=max(2, block // 10))
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], True), (1, 1, [1.0, 0.5], False), (1, 1, [1.0, 0.5], False), (2, 2, [0.7, 0.5], False), (2, 2, [0.7, 0.5], False),
            (3, 2, None, True), (4, None, [1.0, 0.5], True), (5, 2, [nan, 0.5], True), (6, 2, [inf, 0.5], False), (7, 2, [None, 0.5], True),
            (None, 2, [0.7, 0.5], True), (8, 1, [], True), (9, 1, [], False), (10, 2, [], False), (11, 1, [0.0, 0.0], True), (12, 3, [1.0], True),
            (13, 1, [-1.0, -0.5], True), (14, 2, [0.0, 0.0], False)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("q", F.lit(1))
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("anchor")).collect()))
    assert got == plain_negatives(rows)
    assert {r[0] for r in got} == {0, 8, 11, 13}  # also where all scores are 0
    huge = spark.createDataFrame([(0, 1, [3e38], True), (1, 1, [1.0], True), (2, 1, [1.0], False), (3, 2, [0.9], False)], SCHEMA)
    assert {r["anchor_id"] for r in hard_negatives.mine(huge, F.col("anchor")).collect()} == {1}
    assert hard_negatives.mine(df.limit(0), F.col("anchor")).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_a_search_stops_before_it_has_read_a_block():
    rnd = np.random.default_rng(3)
    q = rnd.integers(-100, 100, (20_000, 3))
    lists, tie = hard_negatives.Lists(q), np.arange(20_000)
    anchor = np.array([90, -80, 5])
    scores = q @ anchor
    (got,), scored = hard_negatives.search(lists, anchor, [hard_negatives._ANY], 5, np.ones(20_000, dtype=bool), tie)
    assert got[0].tolist() == np.lexsort((tie, -scores))[:5].tolist() and scored < 6_000
    top = int(scores.max())
    windows = [(top // 2, top * 9 // 10), (-50, -40), (10, 5)]
    found, _ = hard_negatives.search(lists, anchor, windows, 3, q[:, 0] % 2 == 0, tie)
    for (low, high), (rows, _) in zip(windows, found):
        fits = np.flatnonzero((scores >= low) & (scores <= high) & (q[:, 0] % 2 == 0))
        assert rows.tolist() == fits[np.lexsort((fits, -scores[fits]))[:3]].tolist()


# --- alignment -----------------------------------------------------------------------------------------

def plain_alignment(texts, pieces):
    """Per text (n_a, n_b, groups, links, best, sum, sha), all pairs of tokens compared."""
    tok = Tokenizer.from_file(A_PATH)
    tok.encode_special_tokens = True
    tables = cross_align.aligner(A_PATH, B_PATH)
    kept = []
    for t in texts:
        sides = (tok.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)) if t else ([], [])
        spans = []
        for ids, table in zip(sides, (tables.a_table, tables.b_table)):
            data = [table.joined(np.array([i])).tobytes() for i in ids]
            ends = np.cumsum([len(x) for x in data]).tolist() if data else []
            spans.append(list(zip([0] + ends, ends)))
            if t and b"".join(data) != (" " + t).encode():
                sides = ([], [])
        if not sides[0]:
            kept.append((0, 0, 0, Counter(), ""))
            continue
        a, b = sides
        links = Counter((a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e)
        ends, start, said = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), 0, []
        for e in ends:
            said.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, spans[k]) if start <= s < e) for k, ids in enumerate(sides)))
            start = e
        kept.append((len(a), len(b), len(ends), links, ";".join(said)))
    held = Counter(p for k in kept for p in k[3])
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, n_g, sum(links.values()), sum(n for (a, b), n in links.items() if held[a, b] == most[a]),
             sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if said else "")
            for n_a, n_b, n_g, links, said in kept]


@pytest.mark.parametrize("hot", [1 << 20, 7])
def test_alignment_of_odd_texts(spark, pieces, hot):
    texts = [t if t is None or len(t) < 500 else t[:500] for t in ODD] + ["the cat sat", "the cat  sat\non", "thecat " * 9, "naïve café", "the the the"]
    df = spark.createDataFrame([(None if k < 2 else k // 2, t, k) for k, t in enumerate(texts)], "doc_id int, text string, row int")
    got = cross_align.align(df, A_PATH, B_PATH, hot_pairs=hot)
    want = sorted((str(None if k < 2 else k // 2), *x) for k, x in enumerate(plain_alignment(texts, pieces)))
    rows = got.collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:8]) for r in rows) == want
    for r in rows:
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
    assert cross_align.align(df.limit(0), A_PATH, B_PATH).count() == 0


def test_op13_on_short_texts_of_a_table(spark, texts, pieces):
    short = [(d, t) for d, t in texts if len(t or "") < 1500]
    got = cross_align.align(spark.createDataFrame(short, "doc_id long, text string"), A_PATH, B_PATH, keep_groups=False, hot_pairs=3000)
    want = sorted((d, *x) for (d, _), x in zip(short, plain_alignment([t for _, t in short], pieces)))
    assert sorted(map(tuple, got.collect())) == want


def test_windows_are_forgotten_in_time(pieces, monkeypatch):
    al = cross_align.Aligner(A_PATH, B_PATH)
    first = al.align(["one two three", None, "four five"])
    monkeypatch.setattr(cross_align, "REMEMBERED", 0)
    again = al.align(["one two three", None, "four five"])
    assert first["groups"] == again["groups"] and first["pairs"].equals(again["pairs"]) and len(al.known) == 5

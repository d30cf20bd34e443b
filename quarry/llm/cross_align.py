"""Alignment of two tokenizations by anchors at white space.

Every text is tokenized whole by both tokenizers. Where a token of each ends at the same byte and
the next token of each begins with a space, or where the text ends, there is an anchor; two
anchors in a row bound a window of token ids. What a window holds depends on its ids alone, so its
alignment is computed once for each pair of id tuples and remembered in the task: groups between
shared ends, and links between tokens whose bytes overlap. A document is then a list of windows, and
its numbers are sums over these.

How many documents hold a pair of ids linked is counted over the whole corpus in Spark, from one row
per document and distinct pair. Pairs go back to the documents in two ways: those that more than a
``1 / HOT_PAIRS`` share of these rows hold, of which there can be no more than ``HOT_PAIRS``, are a
broadcast that tasks look up; all others are joined by key, none of them with more rows than this.
"""

from __future__ import annotations

import hashlib
import json
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, materialise, quoted, ready_for_texts
from quarry.llm.packing import Encoder
from quarry.llm.piece_bpe import in_chunks, model, taken

HOT_PAIRS = 1 << 20
REMEMBERED = 300_000         # windows that a task remembers
REMEMBERED_LINKS = 6_000_000
CHUNK = 2 << 20              # characters of texts that are worked on at once


# --- tokens and their bytes ------------------------------------------------------------------------

class ByteTokens(Encoder):
    """A byte-level tokenizer file that takes special tokens in texts for plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.slow.encode_special_tokens = True
        self.special = []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}
        shown = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        shown |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.table = Shown([shown.get(i, b"") for i in range(max(shown) + 1)])


class Shown:
    """The bytes of every id."""

    def __init__(self, shown: list[bytes]):
        self.flat = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.length = np.array([len(x) for x in shown], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spaced = np.array([x[:1] == b" " for x in shown])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return taken(self.flat, self.start[ids], self.length[ids])


class Aligner:
    """Both tokenizers and the windows that a task has met."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), model(b_path)
        b = self.b
        self.a_table = self.a.table
        self.b_table = Shown([b.shown[s:s + n].tobytes() for s, n in zip(b.shown_start.tolist(), b.shown_length.tolist())])
        self.b_bits = len(self.b_table.length).bit_length()
        self.bits = self.b_bits + len(self.a_table.length).bit_length()
        # ids in keys; the border between those of the two sides is no id
        self.width = np.dtype("<u2" if max(len(self.a_table.length), len(self.b_table.length)) < 0xFFFF else "<u4")
        self.border = np.iinfo(self.width).max
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        # per window: its groups, all links, distinct links; of the latter the pairs and how often each is linked
        self.groups, self.links, self.distinct, self.pairs, self.times = (np.zeros(0, dtype=np.int64) for _ in range(5))

    def _learn(self, windows: list[bytes]) -> None:
        """Align windows (ids of the first, the border, ids of the second tokenizer) and remember them."""
        ids = np.frombuffer(b"".join(windows), dtype=self.width).astype(np.int64)
        window = np.repeat(np.arange(len(windows)), np.array([len(k) for k in windows]) // self.width.itemsize)
        border = np.flatnonzero(ids == self.border)
        is_a = np.arange(len(ids)) < border[window]
        is_b = np.arange(len(ids)) > border[window]
        a, b, of_a, of_b = ids[is_a], ids[is_b], window[is_a], window[is_b]
        end_a, end_b = np.cumsum(self.a_table.length[a]), np.cumsum(self.b_table.length[b])
        # where a token ends, the token of each side that holds the byte before is linked
        end = np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, end), np.searchsorted(end_b, end)
        key, times = np.unique(of_a[i] << self.bits | a[i] << self.b_bits | b[j], return_counts=True)
        # groups, said in the order of groups, the first tokenizer's ids first
        closed = np.intersect1d(end_a, end_b, assume_unique=True)
        group = np.r_[np.searchsorted(closed, end_a), np.searchsorted(closed, end_b)]
        order = np.argsort(group, kind="stable")
        side = np.repeat([0, 1], [len(a), len(b)])[order]
        own, group = np.r_[of_a, of_b][order], group[order]
        mark = np.where(own[1:] != own[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        said = "".join([f"{x}{',|;/'[m]}" for x, m in zip(np.r_[a, b][order].tolist(), mark.tolist() + [3])])
        groups = np.bincount(of_a[np.searchsorted(end_a, closed)], minlength=len(windows))
        self.known.update(zip(windows, range(len(self.known), len(self.known) + len(windows))))
        self.texts += said[:-1].split("/")
        for name, more in (("groups", groups), ("links", np.bincount(of_a[i], minlength=len(windows))), ("pairs", key & (1 << self.bits) - 1),
                           ("distinct", np.bincount(key >> self.bits, minlength=len(windows))), ("times", times)):
            setattr(self, name, np.r_[getattr(self, name), more])

    def align(self, texts: list[str | None]) -> dict[str, list | pa.Array]:
        """Per text: tokens of each, groups, links, the groups as text, and its distinct pairs of ids,
        in order, with how often each is linked."""
        texts = [t or "" for t in texts]
        data = [(" " + t).encode() if t else b"" for t in texts]
        a_ids = [self.a.encode(" " + t) if t else np.zeros(0, dtype="<u4") for t in texts]
        b_flat, b_ends = self.b.encode(texts)
        # a text whose bytes are not those of its tokens has no tokens
        a_flat = np.concatenate([*a_ids, np.zeros(0, dtype="<u4")]).astype(np.int64)
        a_ends = np.r_[0, np.cumsum([len(x) for x in a_ids])].astype(np.int64)
        b_flat = b_flat.astype(np.int64)
        good = []
        for ids, ends, table in ((a_flat, a_ends, self.a_table), (b_flat, b_ends, self.b_table)):
            joined = table.joined(ids).tobytes()
            at = np.r_[0, np.cumsum(table.length[ids])][ends].tolist()
            good.append([joined[x:y] == d for x, y, d in zip(at, at[1:], data)])
        good = np.array(good, dtype=bool).reshape(2, len(texts)).all(axis=0)
        n_a, n_b = np.where(good, np.diff(a_ends), 0), np.where(good, np.diff(b_ends), 0)
        if not good.all():
            a_flat, b_flat = a_flat[np.repeat(good, np.diff(a_ends))], b_flat[np.repeat(good, np.diff(b_ends))]
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1  # of each text
        # shared ends: both flat arrays cover the same bytes
        end_a, end_b = np.cumsum(self.a_table.length[a_flat]), np.cumsum(self.b_table.length[b_flat])
        i = np.minimum(np.searchsorted(end_a, end_b), max(0, len(end_a) - 1))
        j = np.flatnonzero(end_a[i] == end_b) if len(end_a) else np.zeros(0, dtype=np.int64)
        i = i[j]
        spaced = self.a_table.spaced[np.r_[a_flat, 0]][i + 1] & self.b_table.spaced[np.r_[b_flat, 0]][j + 1]
        final = np.zeros(len(b_flat) + 1, dtype=bool)
        final[last_b[n_b > 0]] = True
        anchor = spaced | final[j]
        i, j = i[anchor] + 1, j[anchor] + 1
        starts_i, starts_j = np.r_[0, i[:-1]], np.r_[0, j[:-1]]
        window_of = np.searchsorted(last_b[n_b > 0], j - 1)
        text_of = np.flatnonzero(n_b > 0)[window_of] if len(window_of) else window_of

        if len(self.known) > REMEMBERED or len(self.pairs) > REMEMBERED_LINKS:
            self._forget()
        # the ids of window k lie from starts_i + starts_j + k on
        k = np.arange(len(i))
        mixed = np.full(len(a_flat) + len(b_flat) + len(i), self.border, dtype=self.width)
        mixed[np.arange(len(a_flat)) + np.repeat(starts_j + k, i - starts_i)] = a_flat
        mixed[np.arange(len(b_flat)) + np.repeat(i + k + 1, j - starts_j)] = b_flat
        raw, size = mixed.tobytes(), self.width.itemsize
        keys = list(map(raw.__getitem__, map(slice, (size * (starts_i + starts_j + k)).tolist(), (size * (i + j + k + 1)).tolist())))
        w = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(w < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(keys[x] for x in new)))
            w[new] = [self.known[keys[x]] for x in new]
        n_groups, n_links = (np.bincount(text_of, weights=x[w], minlength=len(texts)).astype(np.int64) for x in (self.groups, self.links))
        cut = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
        said = list(map(self.texts.__getitem__, w.tolist()))

        # distinct windows of each text, then distinct pairs
        key, times = np.unique(text_of << 40 | w, return_counts=True)
        w, text = key & (1 << 40) - 1, key >> 40
        start, n = (np.cumsum(self.distinct) - self.distinct)[w], self.distinct[w]
        key = np.repeat(text, n) << self.bits | taken(self.pairs, start, n)
        times = taken(self.times, start, n) * np.repeat(times, n)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        times = np.add.reduceat(times[order], first) if len(key) else times
        key = key[first]
        ends = np.searchsorted(key >> self.bits, np.arange(len(texts) + 1))
        pair = key & (1 << self.bits) - 1
        pair = pair >> self.b_bits << 32 | pair & (1 << self.b_bits) - 1
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups": [";".join(said[x:y]) for x, y in zip(cut, cut[1:])],
                "pairs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair)),
                "times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times))}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path)
    return _aligners[key]


# --- jobs --------------------------------------------------------------------------------------------

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    src = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    ddl = (f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS)
           + ", groups_sha256 string, pairs array<long>, times array<long>" + (", groups string" if keep_groups else ""))
    names = ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times"] + ["groups"] * keep_groups

    def run(batches):
        own = aligner(a_path, b_path)
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in in_chunks([len(t or "") for t in texts], CHUNK):
                got = own.align(texts[i:j])
                sha = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(got["groups"], got["n_groups"].tolist())]
                cols = [*b.slice(i, j - i).columns[:2], *[pa.array(got[c], pa.int64()) for c in _COUNTS], pa.array(sha, pa.string()), got["pairs"], got["times"]]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got["groups"], pa.string())] * keep_groups, names=names)

    return src.mapInArrow(run, ddl)


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many rows of ``aligned`` hold a pair (``a << 32 | b``), and whether no
    other pair of its ``a`` is held by more. A window has at most as many rows as there are ``b``."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def _looked_up(table, at: int, keep: list[int], names: list[str]):
    """Tasks: what the broadcast pairs add to each row, and the pairs that it has not."""
    def run(batches):
        own, n, best = table.value
        for b in batches:
            lists, times = b.column(at), b.column(at + 1)
            pair, k = lists.flatten().to_numpy(), times.flatten().to_numpy()
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            i = np.minimum(np.searchsorted(own, pair), max(0, len(own) - 1))
            there = own[i] == pair if len(own) else np.zeros(len(pair), dtype=bool)
            total = np.r_[0, np.cumsum(np.where(there, n[i] * k, 0) if len(own) else 0 * k)][ends]
            top = np.r_[0, np.cumsum(np.where(there & best[i], k, 0) if len(own) else 0 * k)][ends]
            rest = pa.array(np.r_[0, np.cumsum(~there)][ends], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(np.diff(total)), pa.array(np.diff(top)),
                 pa.ListArray.from_arrays(rest, pa.array(pair[~there])), pa.ListArray.from_arrays(rest, pa.array(k[~there]))], names=names)
    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          keep_groups: bool = True, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups])``, one row per
    row of ``docs``: tokens of the byte-level file ``a_path`` and the piece file ``b_path``, which
    every worker has; groups; links; links whose count is the highest of their a id; the sum of the
    counts over links; the groups as text, ``a1,a2|b1;a3|b2,b3``, and its digest ('' without tokens).

    Null and empty texts, and those whose tokens do not give their bytes again, have no tokens:
    zeros. Texts of any length are aligned whole. Repeated rows and ids, null ids too, are documents
    of their own, and count as such. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    ready_for_texts(spark)
    parts = materialise(_aligned(docs, a_path, b_path, id_col, text_col, keep_groups), "align-documents")
    counts = materialise(link_counts(parts), "align-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = math.ceil(total / hot_pairs)
    # no more than hot_pairs of them, whatever the corpus holds
    hot = counts.filter(F.col("n") > many).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    keep = [c for c in parts.columns if c not in ("pairs", "times")]
    src = parts.select(*keep, "pairs", "times")
    names = [*keep, "hot_sum", "hot_best", "rest", "rest_times"]
    ddl = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep) + ", hot_sum long, hot_best long, rest array<long>, rest_times array<long>"
    found = materialise(src.mapInArrow(_looked_up(table, len(keep), list(range(len(keep))), names), ddl), "align-found")
    drop_tables(parts)
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("k"))
    rest = rest.join(counts.filter(F.col("n") <= many), "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("k")).alias("rest_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rest_best"))
    both = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    return found.join(rest, "row", "left").select(
        "doc_id", *_COUNTS, both("hot_best", "rest_best").alias("n_best"), both("hot_sum", "rest_sum").alias("count_sum"),
        "groups_sha256", *["groups"] * keep_groups)

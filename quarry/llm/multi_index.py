"""Embedding near-duplicates over an inverted multi-index.

Vectors are scaled to unit length and cut in halves. Each half has its own codebook of ``K``
centroids, fitted on a bounded sample; the product of the two is a grid of ``K * K`` cells. Every
vector is stored in its nearest cell. As a query it visits cells by a multi-sequence traversal,
in order of the sum of its distances to the two halves' centroids, until it has gone as far past
its nearest cell as a pair at the least similarity needs to meet with probability ``recall``; that
depth is calibrated on sampled vectors and partners drawn at exactly that similarity, the hardest
pairs there are. Pairs that meet in a cell are verified by cosine in double precision.

Equal vectors are one class before the search, so copies never meet. A cell with many vectors is
cut into blocks, and its visitors into chunks, of bounded size; every (cell, block, chunk) is one
group, which gives link counts and a forest of its links, never the pairs. The codebooks and the
sizes of the cells, at most ``K * K`` rows, are all that is broadcast.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, materialise, quoted
from quarry.llm.components import components, forest

SIMILARITY = 0.95
RECALL = 0.995
SAMPLE_ROWS = 20_000   # expected size of the sample that codebooks and depth are fitted on
CELL_ROWS = 64         # vectors a cell should hold
MAX_CENTROIDS = 512    # per half
BLOCK_ROWS = 2_048
CHUNK_ROWS = 4_096


# --- vectors ------------------------------------------------------------------------------------

def _kind(df: DataFrame, vec_col: str) -> str:
    """What a component is kept as: four bytes where the table has no more."""
    return "<f4" if df.select(quoted(vec_col).alias("v")).schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def prepared(df: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """``(id, raw)``: the vector's components as bytes; null where it is null, empty, zero, or
    holds a null or a non-finite component."""
    src = df.select(quoted(id_col).cast("long").alias("id"), quoted(vec_col).cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([math.nan if c is None else c for c in v or []], dtype=np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                # adding zero makes -0.0 equal to 0.0
                out.append((x + 0.0).astype(kind).tobytes() if np.isfinite(top) and top > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "raw"])

    return src.mapInArrow(run, "id long, raw binary")


def units(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors at unit length, in double precision; scaled first, so that no norm overflows."""
    x = np.frombuffer(b"".join(raws), dtype=kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numbered(batches):
    at = TaskContext.get().partitionId() << 40
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(at, at + b.num_rows), pa.int64())],
                                         names=[*b.schema.names, "cls"])
        at += b.num_rows


# --- index --------------------------------------------------------------------------------------

def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows of the (already shuffled) sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, j], minlength=k)
            c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


class Index:
    """Codebooks of both halves and how far past its nearest cell a query goes."""

    def __init__(self, sample: np.ndarray, rows: int, similarity: float, recall: float):
        self.half = sample.shape[1] // 2
        k = int(np.clip(round(math.sqrt(rows / CELL_ROWS)), 1, min(MAX_CENTROIDS, len(sample))))
        self.books = [centroids(part, k) for part in (sample[:, :self.half], sample[:, self.half:])]
        self.k = k
        self.depth = self._depth(sample[:4_096], similarity, recall)

    def spread(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def _depth(self, x: np.ndarray, similarity: float, recall: float) -> float:
        rng = np.random.default_rng(0)
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        partner = similarity * x + math.sqrt(max(0.0, 1 - similarity ** 2)) * noise / np.where(norm > 0, norm, 1)
        a, b = self.spread(x), self.spread(partner)
        row = np.arange(len(x))

        def past(own, other):  # how far past its nearest cell the one goes to the other's
            return (own[0][row, other[0].argmin(axis=1)] + own[1][row, other[1].argmin(axis=1)]
                    - own[0].min(axis=1) - own[1].min(axis=1))
        # a pair is found when either of the two visits the other's cell
        return float(np.quantile(np.minimum(past(a, b), past(b, a)), recall, method="higher")) + 1e-9

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells in order of ``d1 + d2``, from the nearest on, as far as the depth goes. Of the two
        sorted lists of centroids, the heap holds the next combinations to look at."""
        a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        end = d1[a[0]] + d2[b[0]] + self.depth
        out, heap = [], [(d1[a[0]] + d2[b[0]], 0, 0)]
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > end:
                break
            out.append(int(a[i]) * self.k + int(b[j]))
            if j + 1 < len(b):
                heapq.heappush(heap, (d1[a[i]] + d2[b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (d1[a[i + 1]] + d2[b[0]], i + 1, 0))
        return out

    def visited_from(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector, as a query, visits the cell given for it."""
        d1, d2 = self.spread(x)
        row = np.arange(len(x))
        return d1[row, cells // self.k] + d2[row, cells % self.k] <= d1.min(axis=1) + d2.min(axis=1) + self.depth


def fit_index(classes: DataFrame, rows: int, similarity: float, recall: float, kind: str) -> Index:
    share = min(1.0, SAMPLE_ROWS / rows)
    some = classes.select("raw") if share == 1 else classes.select("raw").filter(
        F.pmod(F.xxhash64("raw"), F.lit(1_000_000)) < max(1, int(1_000_000 * share)))
    raws = sorted(some.toArrow().column(0).to_pylist())  # at most SAMPLE_ROWS or so, in a fixed order
    if not raws:
        raws = classes.select("raw").limit(1).toArrow().column(0).to_pylist()
    sample = units(raws, kind)
    return Index(sample[np.random.default_rng(0).permutation(len(sample))], rows, similarity, recall)


# --- search -------------------------------------------------------------------------------------

def _verify(index, similarity: float, kind: str):
    """Groups: the rows of one block of a cell, and one chunk of the vectors that visit the cell
    → link counts ``(u, null, n)`` and a forest ``(u, v, 0)`` of the links found."""
    def run(rows: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        if not len(rows) or not len(visitors):
            return empty
        ix = index.value
        x, xc, xn = units(rows["raw"].tolist(), kind), rows["cls"].to_numpy(), rows["copies"].to_numpy()
        q, qc, qn = units(visitors["q_raw"].tolist(), kind), visitors["q_cls"].to_numpy(), visitors["q_copies"].to_numpy()
        home = visitors["q_home"].to_numpy()
        u, v, counted = [], [], []
        step = max(1, 2_000_000 // len(x))
        for s in range(0, len(q), step):
            i, j = np.nonzero(q[s:s + step] @ x.T >= similarity)
            i = i + s
            other = qc[i] != xc[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            counted.append((qc[i], xn[j]))
            # the row counts this link itself when, as a query, it visits the visitor's cell
            for t in range(0, len(i), 20_000):
                p, r = i[t:t + 20_000], j[t:t + 20_000]
                alone = ~ix.visited_from(x[r], home[p])
                counted.append((xc[r][alone], qn[p][alone]))
            a, b = forest(qc[i], xc[j])
            u.append(a)
            v.append(b)
        if not counted:
            return empty
        a, b = forest(np.concatenate(u), np.concatenate(v))
        who, at = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c[1] for c in counted])).astype(np.int64)
        return pd.DataFrame({"u": np.concatenate([who, a]), "v": pd.array([None] * len(who) + list(b), dtype="Int64"),
                             "n": np.concatenate([n, np.zeros(len(a), np.int64)])})
    return run


def _search(classes: DataFrame, rows: int, similarity: float, recall: float, kind: str) -> DataFrame:
    """Link counts and forests, as above, among classes ``(cls, raw, copies)`` of one length."""
    spark = classes.sparkSession
    index = spark.sparkContext.broadcast(fit_index(classes, rows, similarity, recall, kind))

    def assign(batches):
        ix = index.value
        for b in batches:
            x = units(b.column(1).to_pylist(), kind) if b.num_rows else np.empty((0, 2))
            homes, visits = [], []
            for s in range(0, len(x), 1_024):
                for d1, d2 in zip(*ix.spread(x[s:s + 1_024])):
                    cells = ix.visits(d1, d2)
                    homes.append(int(d1.argmin()) * ix.k + int(d2.argmin()))
                    visits.append(cells)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.int32()), pa.array(visits, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "home", "visits"])

    placed = materialise(classes.select("cls", "raw", "copies").mapInArrow(
        assign, "cls long, raw binary, copies long, home int, visits array<int>"), "vectors-index")
    stored = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n_rows"))
    visiting = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n_visits"))
    # at most K * K rows
    sizes = F.broadcast(materialise(stored.join(visiting, "cell").select(
        "cell", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.col("n_visits") / CHUNK_ROWS).cast("int").alias("chunks")), "vectors-cells"))
    number = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows_side = placed.join(sizes, placed["home"] == sizes["cell"]).select(
        "cell", number(F.col("blocks"), 1).alias("block"), every(F.col("chunks")).alias("chunk"), "cls", "raw", "copies")
    visit_side = (placed.select("cls", "raw", "copies", "home", F.explode("visits").alias("at")).join(sizes, F.col("at") == F.col("cell"))
                  .select("cell", every(F.col("blocks")).alias("block"), number(F.col("chunks"), 2).alias("chunk"), "cls", "raw", "copies", "home"))
    keys = ["cell", "block", "chunk"]
    # both sides come from one table, so the second gets names of its own
    visit_side = visit_side.select(*[F.col(c).alias(f"q_{c}") for c in visit_side.columns])
    return (rows_side.groupBy(*keys).cogroup(visit_side.groupBy(*[f"q_{k}" for k in keys]))
            .applyInPandas(_verify(index, similarity, kind), "u long, v long, n long"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row ``(id, n_links, component_id, kept)`` per vector: the number of other vectors
    linked directly (cosine of at least ``similarity``), the smallest id reachable over links, and
    whether that is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    only vectors of one length are compared; equal vectors, and repeated rows, link with each
    other; rows without id take part, and a component of such rows only has a null
    ``component_id``; an empty table gives an empty table; further columns are not read.
    """
    kind = _kind(df, vec_col)
    rows = materialise(prepared(df, id_col, vec_col, kind), "vectors-rows")
    distinct = rows.filter("raw is not null").groupBy("raw").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(distinct.mapInArrow(_numbered, "raw binary, first_id long, copies long, cls long"), "vectors-classes")
    found = None
    for r in classes.groupBy(F.length("raw").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length
        part = _search(classes.filter(F.length("raw") == r["size"]), r["n"], similarity, recall, kind)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "u long, v long, n long")
    found = materialise(found, "vectors-links")
    links = found.filter("v is null").groupBy(F.col("u").alias("linked")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v is not null"), "u", "v")
    placed = materialise(classes.join(roots, classes["cls"] == roots["node"], "left").join(links, F.col("cls") == F.col("linked"), "left").select(
        "raw", "cls", "first_id", F.coalesce("root", "cls").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-placed")
    lowest = materialise(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "vectors-lowest")
    of = materialise(placed.join(lowest, "root").select(F.col("raw").alias("of"), "n_links", "component_id"), "vectors-of")
    drop_tables(found, roots, classes, placed, lowest)
    linked = rows.filter("raw is not null").join(of, rows["raw"] == of["of"]).select("id", "n_links", "component_id")
    alone = rows.filter("raw is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))

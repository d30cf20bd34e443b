"""Exact vector search: top-k by squared L2 distance, with relevance = 1 − distance.

Plan (no cross join, no all-pairs output, nothing through the driver):

* the corpus is split into cells by a tree of pivots: every node with more rows than a cell should
  hold gets pivots of its own, chosen on a bounded sample of it, and its rows go to the nearest;
  the number of cells grows with the corpus, and the tree is a table like any other;
* a query first searches the nearest cells that together hold k rows; the k-th distance found
  bounds the answer, and by the triangle inequality only nodes with ``d(query, pivot) − radius``
  within it can hold a nearer row: the query descends into those and into no others;
* (cell, block, chunk) groups bring a bounded number of corpus rows and queries together; inside
  one numpy screens the distances with one matrix product, rescores the candidates that an error
  bound cannot exclude exactly in float64, and emits only the k best per query;
* a window over (part, query) keeps the global k best.

Ties are broken by the corpus id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint

# What retrieval keeps to.
SETTINGS = {"max_context_length": 2048, "min_relevance_threshold": 0.5, "max_retrieved_docs": 5}

BLOCK_ROWS = 20_000        # corpus vectors per group
QUERY_CHUNK_ROWS = 20_000  # query vectors per group: a group's block of the corpus is shuffled once for all of them
SCREEN_CELLS = 1_000_000   # distances that a group screens at once


_U = 2.0 ** -53  # unit round-off of float64


def _score_block(k: int):
    """Exact k nearest per query within one (query chunk × corpus block) group.

    Distances are first screened with one matrix product (|q|² + |c|² − 2q·c, BLAS speed).
    Its rounding error is bounded by ``bound`` = (4·dim + 8)·u·(|q|² + max|c|²), so every
    corpus row whose true distance is within the true k-th distance has a screened distance
    ≤ (k-th screened distance) + 2·bound. Only those candidates are rescored exactly as
    Σ(q − c)² and ordered by (distance, id): the result is the exact top-k, ties by id.
    """
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"part": pd.Series(dtype="str"), "qid": pd.Series(dtype="int64"),
                                 "cid": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        Q = np.stack(q["qvec"].to_numpy()).astype(np.float64)
        C = np.stack(c["cvec"].to_numpy()).astype(np.float64)
        cids = c["cid"].to_numpy(dtype=np.int64)
        qids = q["qid"].to_numpy(dtype=np.int64)
        qn = np.einsum("ij,ij->i", Q, Q)
        cn = np.einsum("ij,ij->i", C, C)
        gamma = (4 * Q.shape[1] + 8) * _U
        kk = min(k, C.shape[0])
        out_q, out_c, out_d = [], [], []
        step = max(1, SCREEN_CELLS // C.shape[0])  # bound the screening matrix
        for s in range(0, Q.shape[0], step):
            screen = Q[s:s + step] @ C.T
            screen *= -2.0
            screen += qn[s:s + step, None] + cn[None, :]
            kth = np.partition(screen, kk - 1, axis=1)[:, kk - 1]
            bound = gamma * (qn[s:s + step] + cn.max())
            for r in range(screen.shape[0]):
                cand = np.nonzero(screen[r] <= kth[r] + 2.0 * bound[r])[0]
                diff = C[cand] - Q[s + r]
                d = np.einsum("ij,ij->i", diff, diff)
                order = np.lexsort((cids[cand], d))[:kk]
                out_q.append(np.full(len(order), qids[s + r], dtype=np.int64))
                out_c.append(cids[cand][order])
                out_d.append(d[order])
        part = q["q_part"].iloc[0]
        n = sum(len(a) for a in out_q)
        return pd.DataFrame({"part": [part] * n, "qid": np.concatenate(out_q),
                             "cid": np.concatenate(out_c), "distance": np.concatenate(out_d)})
    return fn


# --- cells: which parts of the corpus a query has to see -----------------------------------------

CELL_ROWS = 20_000       # a cell of more rows is split; as many as a group screens at once
FANOUT = 128             # children of a node at most
ROWS_PER_PIVOT = 50      # expected rows that a pivot is chosen from
FEW_CELLS = 100_000      # so many sizes of cells are sent to all tasks
MAX_LEVELS = 12          # a cell still larger then is searched in blocks
NODE = ["part", "node"]


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots by farthest-first choice over the sample (in its given order), then moved to
    the mean of what is nearest to them a few times."""
    pivots = [sample[0]]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(pivots) < n and near.max() > 0:
        pivots.append(sample[int(near.argmax())])
        near = np.minimum(near, ((sample - pivots[-1]) ** 2).sum(axis=1))
    p = np.array(pivots)
    for _ in range(5):
        own = _distances(sample, p).argmin(axis=1)
        for j in np.unique(own):
            p[j] = sample[own == j].mean(axis=0)
    return p


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Every row of ``x`` to every pivot, from differences, so that the error stays relative."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _meet(rows: DataFrame, key: str, nodes: DataFrame, fn, ddl: str) -> DataFrame:
    """``rows`` cogrouped with the children of their node, at most ``FANOUT`` rows. A node's rows
    are dealt by the hash of ``key`` into chunks of bounded size, each with a copy of the children."""
    # one row per node that was split, so few: rows and vectors are shuffled once, by the cogroup
    chunks = F.broadcast(rows.groupBy(*NODE).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("chunks")))
    dealt = rows.join(chunks, NODE).withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).drop("chunks")
    copies = nodes.join(chunks, NODE).withColumn("n_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    copies = copies.withColumnsRenamed({"part": "n_part", "node": "n_node"})
    return dealt.groupBy(*NODE, "chunk").cogroup(copies.groupBy("n_part", "n_node", "n_chunk")).applyInPandas(fn, ddl)


def _split(rows: DataFrame, level: int) -> DataFrame | None:
    """``(part, node, child, pivot)`` of the nodes that hold more than ``CELL_ROWS`` rows and more
    than one distinct vector; None if there are none."""
    big = reliable_checkpoint(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL_ROWS).withColumn(
        "fan", F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(FANOUT)).cast("int")))
    if big.isEmpty():
        return None
    # by the vector's hash, and distinct, so that copies of one vector do not fill the sample
    number = F.pmod(F.xxhash64("cvec", F.lit(level)), F.lit(1 << 40))
    sample = (rows.join(F.broadcast(big), NODE).filter(number <= F.lit(float(1 << 40)) * ROWS_PER_PIVOT * F.col("fan") / F.col("n"))
              .select(*NODE, "fan", "cvec").distinct())

    def choose(some: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, some["cvec"])), dtype=np.float64)
        pivots = choose_pivots(x, int(some["fan"].iloc[0]))
        n = len(pivots) if len(pivots) > 1 else 0
        return pd.DataFrame({"part": [some["part"].iloc[0]] * n, "node": [some["node"].iloc[0]] * n,
                             "child": pd.Series(range(n), dtype="int32"), "pivot": list(pivots[:n])})

    pivots = reliable_checkpoint(sample.groupBy(*NODE).applyInPandas(choose, "part string, node string, child int, pivot array<double>"))
    return None if pivots.isEmpty() else pivots


def build_cells(corpus: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The corpus ``(part, cid, cvec)`` with the cell (``node``) of each row, and the tree over the
    cells: for each level ``(part, node, child, pivot, n, radius)``, one row per child with the
    number of rows below it and how far away the farthest of them is.

    Nodes with more than ``CELL_ROWS`` rows are split by pivots of their own, level by level, so the
    number of cells grows with the corpus while a node has at most ``FANOUT`` children. Copies of one
    vector cannot be split; a cell of many is cut into blocks by the search."""
    kind = corpus.schema["cvec"].dataType.simpleString()

    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or pivots.empty:
            return pd.DataFrame(columns=["part", "node", "cid", "cvec", "far"], dtype=object)
        d = _distances(_matrix(rows["cvec"]), _matrix(pivots["pivot"]))
        at = d.argmin(axis=1)
        child = pivots["child"].to_numpy()[at]
        return pd.DataFrame({"part": rows["part"], "node": rows["node"].iloc[0] + "." + pd.Series(child, index=rows.index).astype(str),
                             "cid": rows["cid"], "cvec": rows["cvec"], "far": d.min(axis=1)})

    rows = reliable_checkpoint(corpus.select("part", F.lit("0").alias("node"), "cid", "cvec"))
    cells, levels = None, []
    while len(levels) < MAX_LEVELS and (pivots := _split(rows, len(levels))) is not None:
        nodes = F.broadcast(pivots.select(*NODE).distinct())
        whole = rows.join(nodes, NODE, "left_anti")
        cells = whole if cells is None else cells.union(whole)
        moved = reliable_checkpoint(_meet(rows.join(nodes, NODE, "left_semi"), "cid", pivots, assign,
                                          f"part string, node string, cid long, cvec {kind}, far double"))
        sizes = moved.groupBy("part", F.col("node").alias("below")).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        levels.append(reliable_checkpoint(pivots.withColumn("below", F.concat_ws(".", "node", F.col("child").cast("string")))
                                          .join(sizes, ["part", "below"]).select(*NODE, "child", "pivot", "n", "radius")))
        rows = moved.drop("far")
    return rows if cells is None else cells.union(rows), levels


SLACK = 1e-9  # share of the distances compared, far above their rounding


def nearest_children(d: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The nearest children that together hold ``k`` rows, or all."""
    order = np.argsort(d, kind="stable")
    return order[:int(np.searchsorted(np.cumsum(rows[order]), k)) + 1]


def possible_children(d: np.ndarray, radius: np.ndarray, kth: float) -> np.ndarray:
    """Children that may hold a row at distance ``kth`` or less: at distance ``d`` from a pivot
    nothing in its cell is nearer than ``d - radius``, by the triangle inequality."""
    return np.nonzero(d - radius <= kth + SLACK * (d + radius))[0]


def visited_cells(queries: DataFrame, levels: list[DataFrame], k: int, every: bool) -> DataFrame:
    """Queries ``(part, qid, qvec, kth)`` → ``(part, node, qid, qvec, near)``, once per cell to search: the
    nearest cells that together hold ``k`` rows, or with ``every`` all that may hold a row at
    squared distance ``kth`` or less (null: all of the part). ``near`` marks the nearest cells."""
    kind = queries.schema["qvec"].dataType.simpleString()
    cols = ["part", "node", "qid", "qvec", "kth"]

    def descend(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        """A row per query with its children as lists: the vector is not copied for each here."""
        if rows.empty or nodes.empty:
            return pd.DataFrame(columns=[*cols, "to", "also"], dtype=object)
        nodes = nodes.sort_values("child")
        child, n, radius = (nodes[c].to_numpy() for c in ("child", "n", "radius"))
        kth = np.sqrt(rows["kth"].astype(float).fillna(np.inf).to_numpy())
        to, also = [], []
        for i, (d, near) in enumerate(zip(_distances(_matrix(rows["qvec"]), _matrix(nodes["pivot"])), rows["near"])):
            first = nearest_children(d, n, k) if near or not every else np.array([], dtype=int)
            to.append(child[first])
            also.append(child[np.setdiff1d(possible_children(d, radius, kth[i]), first)] if every else child[:0])
        return rows[cols].assign(to=to, also=also)

    def below(rows: DataFrame) -> DataFrame:
        marked = lambda to, near: F.transform(to, lambda x: F.struct(x.alias("child"), F.lit(near).alias("near")))
        children = rows.withColumn("c", F.explode(F.concat(marked("to", True), marked("also", False))))
        return children.withColumn("node", F.concat_ws(".", "node", F.col("c.child").cast("string"))).select(*cols, "c.near")

    here = queries.select("part", F.lit("0").alias("node"), "qid", "qvec", "kth", F.lit(True).alias("near"))
    for level in levels:
        nodes = F.broadcast(level.select(*NODE).distinct())
        met = reliable_checkpoint(_meet(here.join(nodes, NODE, "left_semi"), "qid", level, descend,
                                        f"part string, node string, qid long, qvec {kind}, kth double, to array<int>, also array<int>"))
        here = here.join(nodes, NODE, "left_anti").union(below(met))
    return here.drop("kth")


def _search(go: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``(part, qid, cid, distance)``: the k best of every cell visited. A cell of many rows is cut
    into blocks and its visitors into chunks, so that both sides of a group are bounded."""
    go = go.select("part", "node", "qid", "qvec")
    rows = cells.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    visits = go.groupBy(*NODE).agg(F.count(F.lit(1)).alias("m"))
    # one row per cell
    sizes = reliable_checkpoint(rows.join(visits, NODE).select(
        *NODE, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.col("m") / QUERY_CHUNK_ROWS).cast("int").alias("chunks")))
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_CELLS else sizes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = go.join(sizes, NODE).select(
        F.col("part").alias("q_part"), F.col("node").alias("q_node"), every("blocks").alias("q_block"),
        number("qid", "chunks").alias("q_chunk"), "qid", "qvec")
    c = cells.join(sizes, NODE).select(
        "part", "node", number("cid", "blocks").alias("block"), every("chunks").alias("chunk"), "cid", "cvec")
    return (q.groupBy("q_part", "q_node", "q_block", "q_chunk").cogroup(c.groupBy("part", "node", "block", "chunk"))
            .applyInPandas(_score_block(k), "part string, qid long, cid long, distance double"))


def _usable(df: DataFrame, part: str | None, key: str, vec: str, names: tuple[str, str]) -> DataFrame:
    """``(part, id, vec)`` of the rows whose vector is complete; ``part`` begins with the vector's
    length, so only vectors of one length meet."""
    of = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    complete = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.coalesce(complete, F.lit(False))).select(
        F.concat(F.size(vec).cast("string"), F.lit(":"), of).alias("part"), F.col(key).cast("long").alias(names[0]), F.col(vec).alias(names[1]))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, *, qid: str = "query_id",
                qvec: str = "query_embedding", cid: str = "vec_id", cvec: str = "embedding",
                part_q: str | None = None, part_c: str | None = None) -> DataFrame:
    """Top-k nearest corpus rows per query by squared L2 distance, exact, ties by id.

    ``part_q``/``part_c`` restrict each query to the corpus rows of the same partition value
    (e.g. a collection). Returns (query_id, part, vec_id, rank, distance, relevance).

    Only vectors of one length are compared. Vectors that are null, empty or hold null or
    non-finite components take no part: as queries they have no rows, as corpus rows they are not
    found. A query whose part holds fewer than ``k`` such vectors gets all of them.
    """
    c = _usable(corpus, part_c, cid, cvec, ("cid", "cvec"))
    q = _usable(queries, part_q, qid, qvec, ("qid", "qvec"))
    cells, levels = build_cells(c)
    w = Window.partitionBy("part", "qid").orderBy("distance", "cid")
    go = visited_cells(q.withColumn("kth", F.lit(None).cast("double")), levels, k, False)
    best = _search(go, cells, k).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    if levels:  # a single cell per part has been seen whole
        best = reliable_checkpoint(best)
        kth = best.filter(F.col("rank") == k).select("part", "qid", F.col("distance").alias("kth"))
        # a node on the way to the nearest cells leads to these again, which have been searched
        more = visited_cells(q.join(kth, ["part", "qid"], "left"), levels, k, True).filter(~F.col("near"))
        rest = _search(more, cells, k)
        best = best.drop("rank").union(rest).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return best.select(F.col("qid").alias(qid), F.expr("substring(part, instr(part, ':') + 1)").alias("part"),
                       F.col("cid").alias(cid), "rank", "distance",
                       (F.lit(1.0) - F.col("distance")).alias("relevance"))


def with_content(ranked: DataFrame, content: DataFrame, cid: str = "vec_id") -> DataFrame:
    """Search results with the columns of ``content`` (texts, metadata; one row per id): joined
    after the search, so that texts never travel through it."""
    return ranked.join(content, cid, "left")


def cosine_similarity(a: str, b: str):
    """Cosine of two float arrays in double precision, JVM-side."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(F.col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))
    nb = F.sqrt(F.aggregate(F.col(b), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))
    return F.try_divide(dot, na * nb)


def context_budget(ranked: DataFrame, group_col: str, rank_col: str, words_col: str,
                   max_words: int = 2048) -> DataFrame:
    """Keep documents in rank order while the running word total stays ≤ ``max_words``
    (stops at the first overflow, also when the first document overflows)."""
    w = Window.partitionBy(group_col).orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("cum_words", F.sum(words_col).over(w)).filter(
        F.col("cum_words") <= max_words)


# Prompt templates (context and no-context variants).
PROMPT_WITH_CONTEXT = (
    "Context Information:\n{context}\n\nUser Query: {query}\n\n"
    "Based on the context information provided above, please provide a comprehensive and "
    "accurate response to the user's query. If the context doesn't contain enough information "
    "to fully answer the question, please indicate what information is available and what "
    "might be missing.\n\nResponse:")
PROMPT_NO_CONTEXT = "User Query: {query}\n\nPlease provide a helpful response:"


def build_prompts(queries: DataFrame, contexts: DataFrame, qid: str, query_col: str,
                  rank_col: str, text_col: str, retrieved: DataFrame | None = None) -> DataFrame:
    """One prompt per query: contexts joined by a blank line in rank order (per-query lists
    are bounded by k), or the no-context template when nothing was retrieved. ``retrieved`` holds
    the ids of queries for which something was, also where none of it fits the budget: those get
    the context template with an empty context."""
    ctx = contexts.groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"))))
        .alias("__c"))
    any_ = (retrieved if retrieved is not None else contexts).select(qid).distinct().withColumn("__any", F.lit(True))
    joined = queries.join(ctx, qid, "left").join(any_, qid, "left")
    ctx_text = F.coalesce(F.array_join(F.transform("__c", lambda s: s["t"]), "\n\n"), F.lit(""))
    pre, post = PROMPT_WITH_CONTEXT.split("{context}")
    mid, tail = post.split("{query}")
    with_ctx = F.concat(F.lit(pre), ctx_text, F.lit(mid), F.col(query_col), F.lit(tail))
    npre, ntail = PROMPT_NO_CONTEXT.split("{query}")
    no_ctx = F.concat(F.lit(npre), F.col(query_col), F.lit(ntail))
    n = F.coalesce(F.size("__c"), F.lit(0)).cast("long")
    return joined.select(qid, n.alias("n_context"),
                         F.when(F.col("__any"), with_ctx).otherwise(no_ctx).alias("prompt"))

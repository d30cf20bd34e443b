"""Hard negatives by Fagin's threshold algorithm.

Vectors become integers, ``floor(scale * x)``, so that scores are exact. All rows are dealt into
blocks of about ``BLOCK_ROWS``; in a block every dimension has its rows sorted by value. An anchor
reads these lists together, each from the end that its own component's sign asks for, in steps
that double. Rows met for the first time are scored in full. The products of the anchor with the values
last read add up to the threshold: no row that is still unseen scores more. A search ends when the
threshold is strictly below the k-th score found in each of its windows (below the window's lower
end while fewer than k are found), so ties are always complete.

It is done twice. Positives are sought among the rows of the anchor's label: labels are dealt into
buckets and these into blocks, so a label with a third of all rows is many blocks. Their scores give
each anchor its windows, in which negatives are sought in all blocks, for all windows of the anchor
at once. Every block gives at most k rows a window, and the best of these are taken at the end.

In many dimensions the threshold falls slowly and a search reads most of a block; the work is that
of the anchors against all rows, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, materialise, quoted

BLOCK_ROWS = 16_384      # of the rows that are searched
ANCHOR_ROWS = 4_096      # of anchors that a task searches a block for
FIRST_STEP = 32          # entries of every list that are read first
SCORE_BITS = 62


# --- one block ---------------------------------------------------------------------------------------

class Lists:
    """The rows of a block, and for every dimension their numbers by value."""

    def __init__(self, q: np.ndarray):
        self.q = q
        self.order = np.argsort(q, axis=0, kind="stable")
        self.sorted = np.take_along_axis(q, self.order, axis=0)

    def walk(self, anchor: np.ndarray):
        """Rows not met before and their scores, step by step, each time with the threshold: no row
        that is still to come scores more. None, after the last step."""
        n = len(self.q)
        if not n:
            return
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, dtype=bool)
        depth, step = 0, FIRST_STEP if len(up) + len(down) else n
        while depth < n:
            end = min(n, depth + step)
            if end == n:
                new = np.flatnonzero(~seen)
            else:
                read = np.zeros(n, dtype=bool)
                read[self.order[n - end:n - depth, up]] = True
                read[self.order[depth:end, down]] = True
                new = np.flatnonzero(read & ~seen)
                seen |= read
            depth, step = end, 2 * step
            bound = None if end == n else int(self.sorted[n - end, up] @ anchor[up] + self.sorted[end - 1, down] @ anchor[down])
            yield new, self.q[new] @ anchor, bound


def best(scores: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Where the first ``k`` are, by falling score, then ``tie``."""
    at = np.arange(len(scores))
    if len(at) > k:  # what scores less than the k-th is out before sorting
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((tie[at], -scores[at]))[:k]]


def search(lists: Lists, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, allowed: np.ndarray,
           tie: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For every window of scores (both ends count) the first ``k`` allowed rows and their scores,
    and how many rows were scored. ``tie``: which of two rows of one score is first."""
    scored = 0
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in windows]
    still = [w for w, (low, high) in enumerate(windows) if low <= high]
    if not still:
        return found, 0
    for new, score, bound in lists.walk(anchor):
        scored += len(new)
        ok = allowed[new]
        new, score = new[ok], score[ok]
        for w in list(still):
            low, high = windows[w]
            fits = (score >= low) & (score <= high)
            if fits.any():
                rows, scores = np.r_[found[w][0], new[fits]], np.r_[found[w][1], score[fits]]
                first = best(scores, tie[rows], k)
                found[w] = (rows[first], scores[first])
            least = found[w][1].min() if len(found[w][0]) == k else low
            if bound is not None and bound < least:
                still.remove(w)
        if not still:
            break
    return found, scored


# --- jobs ---------------------------------------------------------------------------------------------

_ANY = (-(1 << SCORE_BITS), 1 << SCORE_BITS)
_FOUND = "anchor long, positive long, score long, row long, id long"


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64)


def _vectors(t: pa.Table) -> np.ndarray:
    if not t.num_rows:
        return np.zeros((0, 1), dtype=np.int64)
    return np.concatenate([c.flatten().to_numpy() for c in t.column("q").chunks]).astype(np.int64).reshape(t.num_rows, -1)


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["anchor", "positive", "score", "row", "id"])


def _each_kind(rows: pa.Table, anchors: pa.Table, names: list[str]):
    """The parts of a block whose rows and anchors agree in the named columns."""
    both = [np.column_stack([_numbers(t, c) for c in names]) for t in (rows, anchors)]
    kinds, kind = np.unique(np.concatenate(both), axis=0, return_inverse=True)
    parts = []
    for of in np.split(kind.ravel(), [len(both[0])]):
        order = np.argsort(of, kind="stable")
        parts.append((order, np.searchsorted(of[order], np.arange(len(kinds) + 1))))
    (of_rows, r), (of_anchors, a) = parts
    for k in np.flatnonzero(np.diff(a)):
        yield rows.take(pa.array(of_rows[r[k]:r[k + 1]])), anchors.take(pa.array(of_anchors[a[k]:a[k + 1]]))


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        for r, a in _each_kind(rows, anchors, ["dim", "label"]):
            lists, number, ids = Lists(_vectors(r)), _numbers(r, "row"), _numbers(r, "id")
            tie = np.argsort(np.lexsort((number, ids)))
            for own, q in zip(_numbers(a, "row"), _vectors(a)):
                ((at, scores),), _ = search(lists, q, [_ANY], k, number != own, tie)
                out += [(own, None, s, number[i], ids[i]) for i, s in zip(at, scores)]
        return _found(out)
    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        for r, a in _each_kind(rows, anchors, ["dim"]):
            lists, number, ids, labels = Lists(_vectors(r)), _numbers(r, "row"), _numbers(r, "id"), _numbers(r, "label")
            tie = np.argsort(np.lexsort((number, ids)))
            for own, q, label, positives in zip(_numbers(a, "row"), _vectors(a), _numbers(a, "label"), a.column("positives").to_pylist()):
                # low * p <= 100 * score <= high * p
                windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
                found, _ = search(lists, q, windows, k, labels != label, tie)
                out += [(own, p["row"], s, number[i], ids[i]) for p, (at, scores) in zip(positives, found) for i, s in zip(at, scores)]
        return _found(out)
    return run


def _together(rows: DataFrame, anchors: DataFrame, keys: list[str], run) -> DataFrame:
    """Blocks of rows and the anchors dealt to them, searched. (Both come of one table: the second
    side's columns are named anew.)"""
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(run, _FOUND)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dealt(spread: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(max(1, spread)))


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for every row
    where ``anchor`` holds and each of its first ``positives`` other rows of its label, the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's. Higher scores are first, ties go by smaller id.

    Rows take no part if the id, the label, the vector or one of its components is null, or a
    component is not finite, or is so large (beyond about 2**31 over the root of the length, when
    scaled) that a score might not fit in a long. Vectors of different length never meet; those
    without components all score 0. Repeated rows and ids are rows of their own, each an anchor, a
    positive and a negative. An empty table, or one without anchors, gives no rows; further columns
    are not read.
    """
    label = quoted(label) if isinstance(label, str) else label
    x = F.transform(quoted(vec_col), lambda v: v.cast("double") * F.lit(float(scale)))
    most = F.lit(float(2 ** (SCORE_BITS // 2))) / F.sqrt(F.greatest(F.size("x"), F.lit(1)).cast("double")) - 1
    src = df.select(quoted(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    src = src.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                     & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < most), F.lit(False))))
    q = F.when(F.size("x") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform("x", lambda v: F.floor(v).cast("long")))
    rows = materialise(src.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", F.size("x").alias("dim"), q.alias("q")),
                       "negatives-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    n_buckets = n_blocks = max(1, math.ceil(size["n"] / block_rows))
    n_anchor_blocks = max(1, math.ceil(size["anchors"] / anchor_rows))
    plain, keys = ["row", "id", "label", "dim", "q"], ["bucket", "block", "anchor_block"]

    # positives: blocks of the buckets that labels are dealt into
    bucket = F.pmod(F.xxhash64("dim", "label"), F.lit(n_buckets))
    counted = rows.groupBy(bucket.alias("bucket")).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"), F.ceil(F.count_if("anchor") / anchor_rows).alias("anchor_blocks"))
    counted = materialise(counted.filter("anchor_blocks > 0"), "negatives-buckets")  # a row for block_rows rows
    own = rows.withColumn("bucket", bucket).join(counted, "bucket")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n))
    sides = [own.select(*plain, "bucket", part("blocks", 1).alias("block"), spread("anchor_blocks").alias("anchor_block")),
             own.filter("anchor").select(*plain, "bucket", spread("blocks").alias("block"), part("anchor_blocks", 2).alias("anchor_block"))]
    found = _together(*sides, keys, _positives(positives))
    chosen = materialise(_first(found, ["anchor"], positives).select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"),
                                                                     F.col("score").alias("positive_score")), "negatives-positives")

    # negatives: all blocks, in the windows that the positives give
    windows = chosen.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(
        F.struct(F.col("positive").alias("row"), F.col("positive_score").alias("score"))).alias("positives"))  # as many as asked for
    keys = keys[1:]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sides = [rows.select(*plain, _dealt(n_blocks, 3).alias("block"), every(n_anchor_blocks).alias("anchor_block")),
             rows.filter("anchor").join(windows, "row").select(*plain, "positives", every(n_blocks).alias("block"), _dealt(n_anchor_blocks, 4).alias("anchor_block"))]
    found = _together(*sides, keys, _negatives(negatives, low, high))
    first = _first(found, ["anchor", "positive"], negatives)
    names = rows.filter("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = materialise(first.join(chosen, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")), "negatives-found")
    drop_tables(rows, counted, chosen)
    return out

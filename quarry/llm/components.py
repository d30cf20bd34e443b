"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a min-aggregate per node (combined map-side) joined back to the links. The
aggregate is written to the shared folder before the join, so both join inputs are fresh
exchanges and a node that holds a third of all links is split by adaptive execution. The
number of rounds grows with the logarithm of the longest chain; nothing but two totals per
round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, materialise

FOREST_ROWS = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links ``a``–``b``: every node with the smallest
    node of its group (at most nodes - 1 links)."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[: len(a)], idx[len(a):]
    root = np.arange(len(nodes))
    while True:
        lo = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], lo)
        np.minimum.at(new, root[v], lo)
        np.minimum.at(new, u, lo)
        np.minimum.at(new, v, lo)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _forests(batches):
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= FOREST_ROWS:
            yield _batch(*forest(*map(np.concatenate, zip(*held))))
            held, n = [], 0
    if held:
        yield _batch(*forest(*map(np.concatenate, zip(*held))))


def _batch(u, v):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours get linked to its smallest one."""
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
    out = materialise(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
    drop_tables(low)
    return out


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours get linked to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialise(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
    drop_tables(low)
    return out


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
    return tuple(r)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node of ``links`` that is not its component's smallest node;
    ``root`` is that smallest node. Node ids are longs. Rows with a null end and links of a node
    with itself are ignored; repeated links count once. An empty table gives an empty table."""
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = materialise(e.mapInArrow(_forests, "u long, v long").distinct(), "cc-links")
    before = _state(e)
    if before[0] == 0:
        return _named(e)
    while True:
        big = _large_star(e)
        drop_tables(e)
        e = _small_star(big)
        drop_tables(big)
        now = _state(e)
        if now == before:
            return _named(e)
        before = now


def _named(e: DataFrame) -> DataFrame:
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._scratch_path = e._scratch_path  # the caller may drop it
    return out

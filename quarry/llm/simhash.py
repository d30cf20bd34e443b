"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the 64-bit majority vote over the XXH64 hashes of its word shingles.
Texts link when their fingerprints differ in at most ``radius`` bits. Every bit position gets a
non-zero vector of ``radius + 1`` bits; for each non-zero vector ``v`` the mask keeps the
positions whose vector has an odd product with ``v``. The positions in which two fingerprints
differ, at most ``radius``, span less than the whole space, so some ``v`` is orthogonal to them
all: under that mask the two are equal. The ``2 ** (radius + 1) - 1`` tables therefore miss no
pair within the radius.

Equal fingerprints form one class before any search. A bucket of at most ``BUCKET`` classes is
compared directly inside one task; a larger one is re-keyed by flipping up to ``radius // 2`` of
the bits its mask leaves open (and up to the rest on the other side), which bounds every group
by the number of such bit patterns whatever the corpus holds.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, materialise, quoted
from quarry.llm.components import components, forest

BITS = 64
SEED = 42
BUCKET = 64
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: lower-cased (A-Z) words between ASCII white space, shingles of
    ``shingle`` words with repeats; fewer words are one shingle, none gives 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(grams), HASH_CHUNK):
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[i:i + HASH_CHUNK]], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(grams))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, text_hash, fp)`` per row; ``text_hash`` tells rows of one id with other texts apart."""
    src = docs.select(quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("text_hash"),
                      quoted(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())],
                                             names=["id", "text_hash", "fp"])

    return src.mapInArrow(run, "id long, text_hash long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The masks described above, as unsigned integers."""
    space = (1 << (radius + 1)) - 1
    vectors = [i % space + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(vectors[i] & v).count("1") % 2) for v in range(1, space + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _close_links(radius: int):
    """Tasks: buckets (arrays of at most BUCKET fingerprints) → a forest of their close pairs."""
    def run(batches):
        for b in batches:
            out_u, out_v = [], []
            for members in b.column(0).to_pylist():
                fp = np.array(members, dtype=np.int64)
                dist = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64))
                i, j = np.nonzero(np.triu(dist <= radius, 1))
                if len(i):
                    u, v = forest(fp[i], fp[j])
                    out_u.append(u)
                    out_v.append(v)
            cat = (lambda x: np.concatenate(x) if x else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cat(out_u), pa.int64()), pa.array(cat(out_v), pa.int64())],
                                             names=["u", "v"])
    return run


def _flips(mask: int, upto: int) -> list[int]:
    """All patterns of at most ``upto`` bits outside the mask, the empty one included."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in c)) for n in range(upto + 1) for c in combinations(free, n)]


def close_links(classes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Rows ``(u, v)`` that join, directly or over others, exactly the distinct fingerprints
    (column ``fp``) that all pairs at most ``radius`` bits apart would join."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks)])
    rows = (classes.select("fp", F.explode(tables).alias("x"))
            .select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")))
    shared = materialise(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
    held = materialise(rows.join(shared, ["t", "key"]), "simhash-members")
    small = (held.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
             .select("members").mapInArrow(_close_links(radius), "u long, v long"))
    # Two fingerprints within the radius meet at a point at most ceil(radius / 2) flips from both
    # when the radius is even. For an odd radius the ends may be radius // 2 + 1 flips away, so
    # pairs under a meeting point are verified as well.
    reach = (radius + 1) // 2
    probes = F.element_at(F.array(*[F.array(*[F.lit(x) for x in _flips(m, reach)]) for m in masks]), F.col("t") + 1)
    met = (held.filter(F.col("n") > bucket).select("t", "fp", F.explode(probes).alias("flip"))
           .groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("probe"))
           .agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1))
    large = met.select("members").mapInArrow(_close_links(radius), "u long, v long")
    return small.union(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """One row ``(id, text_hash, fingerprint, component_id, root)`` per row of ``docs``; ``root``
    is the component's smallest fingerprint, as a signed number.

    ``component_id`` is the smallest id reachable over links (fingerprints at most ``radius``
    bits apart), the row's own included. Null, empty and wordless texts have fingerprint 0 and
    link like any other; rows with a null id take part, and a component of null ids only has a
    null ``component_id``; repeated rows come out as often as they went in; an empty table gives
    an empty table; further columns of ``docs`` are not read. Texts are hashed whole.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    classes = materialise(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    roots = components(close_links(classes, radius), "u", "v")
    placed = materialise(classes.join(roots, classes["fp"] == roots["node"], "left")
                         .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    lowest = materialise(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-lowest")
    of = materialise(placed.join(lowest, "root").select(F.col("fp").alias("class_fp"), "root", "component_id"), "simhash-of")
    drop_tables(classes, roots, placed, lowest)
    return (fps.join(of, fps["fp"] == of["class_fp"])
            .select("id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                radius: int = 2) -> DataFrame:
    """``docs`` less all but one row of each component: the one with the smallest id (ids that
    are null come last; of rows with that id, the one with the smallest text hash; of identical
    rows, one). All columns are kept as they are."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    # rows of one id and text count as one candidate, with their number
    candidates = found.groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"), F.col("n").alias("n"))
    keep = materialise(candidates.groupBy("root").agg(F.min(rank).alias("r"))
                       .select(F.col("r.id").alias("__keep_id"), F.col("r.text_hash").alias("__keep_hash"), F.col("r.n").alias("__keep_n")), "simhash-keep")
    own = [quoted(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)]
    d = docs.select(*own, quoted(id_col).cast("long").alias("__row_id"), F.xxhash64(quoted(text_col)).alias("__row_hash"))
    kept = d.join(keep, F.col("__row_id").eqNullSafe(F.col("__keep_id")) & (F.col("__row_hash") == F.col("__keep_hash")))
    columns = [F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    if keep.filter("__keep_n > 1").isEmpty():  # no repeated rows: the join's result is it
        return kept.select(*columns)
    once = kept.filter("__keep_n > 1").dropDuplicates(["__row_id", "__row_hash"])
    return kept.filter("__keep_n = 1").select(*columns).unionByName(once.select(*columns))

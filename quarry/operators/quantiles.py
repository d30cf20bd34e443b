"""Exact interpolated quantiles per group without gathering or globally sorting a group.

Values are cut into buckets by splits taken from an approximate percentile sketch; every split
has a bucket of its own, so a value that a third of all rows share is alone in one. Rows are
first reduced to counts per (group, bucket), which tell the bucket that holds each wanted rank.
Where a bucket holds one value that is the answer; of the others only the rows of the buckets
found are read again and numbered. A bucket found with more than ``BUCKET_ROWS`` rows is cut again
by percentile points of its own, as often as it takes, so no task numbers more rows than that.

With ``fan`` the rows carry a finer key than the groups (minutes of sliding windows): counts are
made per fine key and fanned out to the groups, and so are the few rows that are read again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint

SPLITS = 500
BUCKET_ROWS = 500_000  # rows of one bucket that are numbered by one task
CUTS = 100             # percentile points that a larger bucket is cut by


def value_splits(df: DataFrame, value_col: str, n: int = SPLITS) -> list[float]:
    """Increasing bucket bounds: each percentile point and the next double after it."""
    points = df.agg(F.percentile_approx(value_col, [i / n for i in range(n + 1)], 20 * n).alias("p")).first()["p"] or []
    bounds = {float(p) for p in points if p is not None and math.isfinite(p)}
    return [-math.inf, *sorted(bounds | {math.nextafter(b, math.inf) for b in bounds}), math.inf]


def _narrowed(read: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read`` (``__g, __b, __v``) and ``wanted`` ranks with every bucket of more than
    ``BUCKET_ROWS`` rows cut into smaller ones, named by a path. Each round takes the least and the
    greatest value and ``CUTS`` points between apart, so it ends, copies of one value at the latest
    when they are alone in a bucket."""
    bucket = ["__g", "__b"]
    while True:
        big = wanted.filter((F.col("n") > BUCKET_ROWS) & (F.col("lo") < F.col("hi")))
        if big.isEmpty():
            return read, wanted
        large = big.select(*bucket).distinct()
        inside = reliable_checkpoint(read.join(large, bucket))
        points = inside.groupBy(*bucket).agg(F.array_distinct(F.percentile_approx(
            "__v", [i / CUTS for i in range(CUTS + 1)], 100 * CUTS)).alias("__p"))
        below = F.size(F.filter("__p", lambda p: p < F.col("__v")))
        cut = inside.join(points, bucket).select(
            *bucket, "__v", (2 * below + F.array_contains("__p", F.col("__v")).cast("int")).alias("__s"))
        sizes = cut.groupBy(*bucket, "__s").agg(F.count(F.lit(1)).alias("m"), F.min("__v").alias("l"), F.max("__v").alias("h"))
        # at most 2 * CUTS + 3 rows of a bucket
        ends = sizes.withColumn("before", F.sum("m").over(Window.partitionBy(*bucket).orderBy("__s")) - F.col("m"))
        path = F.concat_ws(".", F.col("__b"), F.col("__s").cast("string")).alias("__b")
        found = big.join(ends, bucket).filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("m"))).select(
            "__g", path, F.col("l").alias("lo"), F.col("h").alias("hi"), "total", "q", "side",
            (F.col("at") - F.col("before")).alias("at"), F.col("m").alias("n"))
        kept = wanted.filter((F.col("n") <= BUCKET_ROWS) | (F.col("lo") >= F.col("hi")))
        wanted = reliable_checkpoint(kept.select(*found.columns).union(found))
        read = read.join(large, bucket, "left_anti").select("__g", "__b", "__v").union(cut.select("__g", path, "__v"))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                    keys: list[str] | None = None, fan: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per group (nulls in group columns are a group): interpolated quantiles
    (``quantile_cont``) of the non-null values, named as in ``probs``. With ``fan``, ``keys`` are
    the fine key columns, and ``fan`` adds the group columns to a table that has them."""
    keys, fan = keys or group_cols, fan or (lambda d: d)
    base = df.filter(F.col(value_col).isNotNull()).select(*keys, F.col(value_col).cast("double").alias("__v"))
    cut = Bucketizer(splits=value_splits(base, "__v"), inputCol="__v", outputCol="__b", handleInvalid="keep")
    rows = cut.transform(base).withColumn("__b", F.col("__b").cast("int"))
    fine = reliable_checkpoint(rows.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    group = F.struct(*group_cols).alias("__g")
    per = fan(fine).groupBy(*group_cols, "__b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(group, "__b", "n", "lo", "hi")
    # per group at most a row for each bucket
    w = Window.partitionBy("__g").orderBy("__b")
    ranked = per.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("__g")))
    ends = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), f(F.lit(p) * (F.col("total") - 1)).alias("rank"))
                     for q, p in probs.items() for side, f in ((0, F.floor), (1, F.ceil))])
    wanted = reliable_checkpoint(ranked.select("__g", "__b", "n", "lo", "hi", "upto", "total", F.explode(ends).alias("e")).filter(
        (F.col("e.rank") < F.col("upto")) & (F.col("e.rank") >= F.col("upto") - F.col("n"))).select(
        "__g", F.col("__b").cast("string").alias("__b"), "lo", "hi", "total", "e.q", "e.side",
        (F.col("e.rank") - F.col("upto") + F.col("n")).alias("at"), "n"))
    # the fine keys whose rows fall into a bucket that is still open, with the groups they serve
    spots = fan(fine.select(*keys, "__b")).select(group, F.col("__b").cast("string").alias("__b"), F.struct(*keys).alias("__k")).join(
        wanted.filter("lo < hi").select("__g", "__b").distinct(), ["__g", "__b"])
    read = rows.select(F.struct(*keys).alias("__k"), F.col("__b").cast("string").alias("__b"), "__v").join(spots, ["__k", "__b"])
    read, wanted = _narrowed(read.select("__g", "__b", "__v"), wanted)
    plain = wanted.filter("lo = hi").select("__g", "total", "q", "side", F.col("lo").alias("v"))
    open_ = wanted.filter("lo < hi")
    # of the smaller buckets only those that hold a wanted rank
    read = read.join(open_.select("__g", "__b").distinct(), ["__g", "__b"], "left_semi")
    numbered = read.withColumn("at", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__v")) - 1)
    found = numbered.select("__g", "__b", "at", "__v").join(open_, ["__g", "__b", "at"]).select(
        "__g", "total", "q", "side", F.col("__v").alias("v"))
    both = plain.union(found)
    out = []
    for q, p in probs.items():
        lo, hi = (F.max(F.when((F.col("q") == q) & (F.col("side") == s), F.col("v"))) for s in (0, 1))
        part = F.lit(p) * (F.max("total") - 1)
        out.append((lo + (part - F.floor(part)) * (hi - lo)).alias(q))
    return both.groupBy("__g").agg(*out).select("__g.*", *probs)

"""Global row numbering without funnelling the table through one partition.

``row_number() over (order by k)`` with no partition key moves every row into one task.
Instead: range-partition and sort by the key (a distributed sort), materialise that once
(checkpoint in the shared folder, so both passes see identical partitions even after an
executor loss), count rows per partition (one tiny aggregate), turn the counts into
offsets over that small result, and add each row's position inside its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint


def global_index(df: DataFrame, order_cols: list[str], out_col: str = "row_index") -> DataFrame:
    """0-based position of each row in the total order ``order_cols`` (ties must not occur:
    include a unique column last)."""
    ordered = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
               .withColumn("__pid", F.spark_partition_id())
               .withColumn("__mid", F.monotonically_increasing_id()))
    ordered = reliable_checkpoint(ordered)
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # one row per partition: a bounded broadcast
    out = ordered.join(F.broadcast(offsets), "__pid")
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return out.withColumn(out_col, F.col("__off") + local).drop("__pid", "__mid", "__off")


def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int = 1000) -> DataFrame:
    """Rows in order, cut into consecutive batches of ``batch_size``."""
    idx = global_index(df, order_cols)
    return idx.withColumn("batch_id", F.floor(F.col("row_index") / batch_size))

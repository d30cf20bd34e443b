"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: a start and a
stride, both hashed from its name, which together visit every slot once. The shards take turns
claiming the first slot of their order that is still free, until the table is full; a shard with
weight ``w`` gets ``w`` turns a round. Shares are equal to within one slot a turn, and when a
shard leaves, the slots of the others hardly move.

The table depends on the shard names alone, not on the data: ``TABLE_SIZE`` rows, built once and
broadcast. A row's place is one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import quoted, without

TABLE_SIZE = 65_537
COLUMNS = ["slot", "shard"]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Start and stride of a shard's order; the stride is below the prime size, so it is a
    permutation."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """For every slot the position of its shard in the sorted list of distinct names. The order
    in which shards are given does not matter. A shard of weight 0 gets no slot."""
    names = sorted(set(shards))
    turns = [(weights or {}).get(n, 1) for n in names]
    if not any(turns) or min(turns) < 0 or not is_prime(size) or size < len(names):
        raise ValueError("shards of positive weight are needed, and a prime table size of at least their number")
    orders = [preference(n, size) for n in names]
    at = [0] * len(names)
    table = [-1] * size
    free = size
    while free:
        for i, (start, stride) in enumerate(orders):
            for _ in range(min(turns[i], free)):
                slot = (start + at[i] * stride) % size
                while table[slot] >= 0:
                    at[i] += 1
                    slot = (start + at[i] * stride) % size
                table[slot] = i
                at[i] += 1
                free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``(slot, shard)``, ``size`` rows: the filled table as one literal, taken apart by Spark."""
    names = sorted(set(shards))
    table = ",".join(map(str, fill_table(shards, size, weights)))
    owner = F.element_at(F.array(*map(F.lit, names)), F.col("i").cast("int") + 1)
    return (spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "i"))
            .select("slot", owner.alias("shard")))


def place(df: DataFrame, key_cols: list[str], shards: list[str], size: int = TABLE_SIZE,
          weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, by the hash of ``key_cols``.

    Null keys hash like a value of their own and are placed; equal keys share a shard, so repeated
    rows stay together; an empty table gives an empty table. Columns called slot and shard are
    replaced, all others kept.
    """
    base = without(df, COLUMNS)
    lookup = table_frame(df.sparkSession, shards, size, weights).select(F.col("slot").alias("__slot"), "shard")
    slot = F.pmod(F.xxhash64(*[quoted(c) for c in key_cols]), F.lit(size)).cast("int")
    keyed = base.select(*[quoted(c) for c in base.columns], slot.alias("slot"))
    # the table has ``size`` rows whatever the data
    return keyed.join(F.broadcast(lookup), keyed["slot"] == lookup["__slot"]).drop("__slot")

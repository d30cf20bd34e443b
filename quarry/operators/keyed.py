"""Keyed table maintenance: upsert (replace on key), insert-if-absent, delete by key list.

All three are a single anti join on the key plus a union; the anti join is a shuffle join on
the key (or a broadcast when the key list is small and Catalyst/AQE know it), never a
driver-side key set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order`` (later wins), ties and a missing order settled by
    the remaining columns, so the choice never depends on how rows are spread. An aggregate, so
    a key with very many rows is reduced within each task first."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = [c for c in order or [] if c not in keys]
    rank = F.struct(*[F.col(c) for c in first], F.struct(*[F.col(c) for c in rest]).alias("__row"))
    return (df.groupBy(*keys).agg(F.max(rank).alias("__best"))
            .select(*keys, *[F.col("__best.__row")[c].alias(c) for c in rest]).select(*df.columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Replace-on-key load: target rows whose key appears in source are replaced by source, of
    which one row per key counts (see ``one_per_key``)."""
    kept = target.join(source.select(*keys).distinct(), on=keys, how="left_anti")
    return kept.unionByName(one_per_key(source.select(*target.columns), keys, order))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Adding an existing id leaves the old document: only new keys are appended, each once."""
    fresh = one_per_key(new, keys, order).join(existing.select(*keys).distinct(), on=keys, how="left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def delete_keys(df: DataFrame, key_list: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(key_list.select(*keys).distinct(), on=keys, how="left_anti")

"""Warehouse tables that are replaced by key, bucket by bucket, and published all at once.

A store is a folder. A table's rows lie in buckets by the hash of its key; each load writes only the
buckets that its keys fall into, to a folder of its own, and never touches what is there. What the
tables consist of is said by a manifest, a small numbered file; the greatest number counts. A
load, also one of several tables, becomes visible by one rename that puts the next manifest in its place. A
job that stops anywhere before leaves the tables as they were, and what it has written is nobody's
until ``vacuum`` removes it.

Of two jobs that publish at the same time the second finds its number taken and fails; it may be
run again.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import keyed
from quarry.session import scratch_path
from quarry.sources.sinks import rebalanced

BUCKETS = 16   # of a table's first load, where the caller names no other number
BUCKET = "__bucket"
MANIFESTS = "_manifests"


@dataclass
class Staged:
    """A table's next state, written but not published."""

    name: str
    entry: dict

    @property
    def rows(self) -> int:
        return sum(self.entry["rows"].values())


# --- manifests -----------------------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def _versions(spark: SparkSession, root: str) -> list[int]:
    folder = os.path.join(root, MANIFESTS)
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(folder))]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    text = spark.read.text(os.path.join(root, MANIFESTS, f"{version:08d}.json"), wholetext=True).first()[0]  # one small file
    return json.loads(text)


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and tables of the current manifest; 0 and no tables before the first."""
    found = _versions(spark, root)
    return (found[-1], _manifest(spark, root, found[-1])) if found else (0, {})


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    fs, at = _fs(spark, path)
    staged = at(os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}"))
    out = fs.create(staged)
    out.write(text.encode())
    out.close()
    if fs.exists(at(path)) or not fs.rename(staged, at(path)):
        fs.delete(staged, False)
        raise RuntimeError(f"{path} is there already: another job has published meanwhile")


def publish(spark: SparkSession, root: str, staged: list[Staged], base: int | None = None) -> int:
    """Make the staged tables the current ones, all at once; the others stay. ``base``: the version that
    they were staged from, which must still be the current one. Returns the new version."""
    version, tables = current(spark, root)
    if base is not None and base != version:
        raise RuntimeError(f"staged from version {base}, but {version} has been published meanwhile")
    tables = {**tables, **{s.name: s.entry for s in staged}}
    _put(spark, os.path.join(root, MANIFESTS, f"{version + 1:08d}.json"), json.dumps(tables, sort_keys=True))
    return version + 1


# --- tables --------------------------------------------------------------------------------------------

def _schema(entry: dict) -> T.StructType:
    return T.StructType.fromJson(entry["schema"])


def _read(spark: SparkSession, root: str, entry: dict, buckets: list[str] | None = None) -> DataFrame:
    folders = [os.path.join(root, f) for b, f in entry["folders"].items() if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], _schema(entry))
    return spark.read.schema(_schema(entry)).parquet(*folders)  # no more than there are buckets


def tables(spark: SparkSession, root: str) -> list[str]:
    return sorted(current(spark, root)[1])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the current manifest, which later loads do not change."""
    _, found = current(spark, root)
    if name not in found:
        raise ValueError(f"no table {name} in {root}")
    return _read(spark, root, found[name])


def read_staged(spark: SparkSession, root: str, staged: Staged) -> DataFrame:
    """A table as it will be once it is published."""
    return _read(spark, root, staged.entry)


def _written(df: DataFrame, root: str, name: str, spread: bool) -> tuple[dict, dict]:
    """Write bucketed rows to a folder of their own: folder and rows of each bucket."""
    spark = df.sparkSession
    folder = os.path.join(name, f"load-{uuid.uuid4().hex}")
    path = os.path.join(root, folder)
    (rebalanced(df, [BUCKET]) if spread else df).write.partitionBy(BUCKET).parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name != BUCKET] + [T.StructField(BUCKET, T.LongType())])
    counts = spark.read.schema(schema).parquet(path).groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a bucket
    return ({str(r[BUCKET]): os.path.join(folder, f"{BUCKET}={r[BUCKET]}") for r in counts}, {str(r[BUCKET]): int(r["n"]) for r in counts})


def _plain(schema: T.StructType) -> dict:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).jsonValue()


def stage_rows(source: DataFrame, root: str, name: str, keys: list[str], order: list[str] | None = None,
               buckets: int = BUCKETS, replace: bool = True) -> Staged:
    """The next state of a table in which ``source`` replaces rows by key (``replace`` false: only adds
    keys that are not there), one row per key by ``order``. Only the buckets that the keys of
    ``source`` fall into are read and written. Rows without a key are in one bucket and never replaced.
    The number of buckets is that of the first load."""
    spark = source.sparkSession
    entry = current(spark, root)[1].get(name)
    if entry is not None and entry["keys"] != keys:
        raise ValueError(f"{name} is kept by {entry['keys']}, not by {keys}")
    n = entry["buckets"] if entry else buckets
    columns = [f["name"] for f in entry["schema"]["fields"]] if entry else source.columns
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n).cast("long"))
    fresh = scratch_path(spark, "store-fresh")
    keyed.one_per_key(source.select(*columns), keys, order).withColumn(BUCKET, bucket).write.parquet(fresh)
    fresh = spark.read.parquet(fresh)
    touched = [str(r[0]) for r in fresh.select(BUCKET).distinct().collect()]  # no more than there are buckets
    state = fresh.drop(BUCKET)
    if entry is not None:
        merge = keyed.upsert if replace else keyed.insert_if_absent
        state = merge(_read(spark, root, entry, touched), state, keys)
    folders, rows = _written(state.withColumn(BUCKET, bucket), root, name, True) if touched else ({}, {})
    before = entry or {"folders": {}, "rows": {}, "schema": _plain(source.schema)}
    return Staged(name, {"keys": keys, "buckets": n, "schema": before["schema"],
                         "folders": {**before["folders"], **folders}, "rows": {**before["rows"], **rows}})


def stage_whole(df: DataFrame, root: str, name: str) -> Staged:
    """The next state of a table that is written anew each time."""
    folders, rows = _written(df.withColumn(BUCKET, F.lit(0).cast("long")), root, name, False)
    return Staged(name, {"keys": [], "buckets": 1, "schema": _plain(df.schema), "folders": folders, "rows": rows})


def load(source: DataFrame, root: str, name: str, keys: list[str], order: list[str] | None = None,
         buckets: int = BUCKETS, replace: bool = True) -> int:
    """Stage and publish one table; returns its rows afterwards."""
    base, _ = current(source.sparkSession, root)
    staged = stage_rows(source, root, name, keys, order, buckets, replace)
    publish(source.sparkSession, root, [staged], base)
    return staged.rows


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove manifests but the last ``keep`` (at least one), and folders of loads that none of these
    names: those of older versions, and of jobs that did not get to publish. Not to be run beside a
    load. Returns the number of load folders removed."""
    found = _versions(spark, root)
    kept = found[-max(1, keep):]
    used = {os.path.dirname(f) for v in kept for e in _manifest(spark, root, v).values() for f in e["folders"].values()}
    fs, path = _fs(spark, root)
    names = {n for v in found for n in _manifest(spark, root, v)}
    removed = 0
    for name in sorted(names):
        folder = os.path.join(root, name)
        for f in fs.listStatus(path(folder)) if fs.exists(path(folder)) else []:
            own = f.getPath().getName()
            if own.startswith("load-") and os.path.join(name, own) not in used:
                fs.delete(f.getPath(), True)
                removed += 1
    for v in found:
        if v not in kept:
            fs.delete(path(os.path.join(root, MANIFESTS, f"{v:08d}.json")), False)
    return removed

"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job in the library assumes: ANSI semantics (strict casts raise, try_* give
# null), UTC clocks so date arithmetic matches the oracle, and AQE so shuffle partition
# counts, skewed joins and join strategies are re-planned from runtime statistics.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # checkpoint files go when nothing in the driver refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quarry",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_own_folders: list[str] = []  # temporary folders made here, by single-process sessions


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator (a shared filesystem path) and must
    be: a folder of the driver's own would not be seen by executors. Only a single-process
    ``local`` master, as in tests, gets a temporary folder when nothing is configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        if not _own_folders:
            atexit.register(_clear_at_exit)
        _own_folders.append(configured)
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def reliable_checkpoint(df):
    """Materialise ``df`` into the shared checkpoint folder and cut its lineage (a lost
    executor re-reads the files instead of recomputing upstream stages)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: dict[int, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written intermediate tables. It
    is removed by ``clear_scratch``, at the latest when the driver's Python ends."""
    base = ensure_checkpoint_dir(spark)
    ship_package(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    if not _scratch and not _own_folders:
        atexit.register(_clear_at_exit)
    _scratch.setdefault(id(spark.sparkContext), []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables written so far. Results that still read them must have
    been consumed."""
    sc = spark.sparkContext
    for path in _scratch.pop(id(sc), []):
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(spark: SparkSession, path: str) -> None:
    """Remove one intermediate table before the rest, once nothing reads it any more."""
    sc = spark.sparkContext
    if path in _scratch.get(id(sc), []):
        _scratch[id(sc)].remove(path)
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def _clear_at_exit() -> None:
    """With a live session, through its file system; of a stopped one, what lies on local paths."""
    spark = SparkSession._instantiatedSession
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone before Python ends
            clear_scratch(spark)
    for path in [p for paths in _scratch.values() for p in paths] + _own_folders:
        local = re.sub("^file:(//)?", "", path)
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark application. Where the
    workers inherit a ``PYTHONPATH`` that holds it there is nothing to do; else it is added to
    the application's files, as ``spark-submit --py-files`` would."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    inherited = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in inherited or getattr(sc, "_quarry_shipped", False):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "quarry")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    before = list(sys.path)
    sc.addPyFile(name)
    sys.path[:] = before  # the driver goes on with the modules it has
    sc._quarry_shipped = True

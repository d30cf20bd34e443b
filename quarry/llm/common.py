"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.session import discard, scratch_path, ship_package


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_TEXTS = 1_000


def ready_for_texts(spark) -> None:
    """Before tasks read texts in Python: the package is there, and an Arrow batch holds at most
    ``BATCH_TEXTS`` rows, since texts are long (a smaller setting stays)."""
    ship_package(spark)
    if int(spark.conf.get(BATCH_SETTING)) > BATCH_TEXTS:
        spark.conf.set(BATCH_SETTING, BATCH_TEXTS)


def give_back() -> None:
    """Memory that was freed goes back to the system. Workers live on for later tasks, and the
    allocators would keep the peak of the last one beside the executor's heap; so does the driver."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back: lineage is cut, a
    lost executor costs a re-read, and the reader's partitioning is unknown to the planner, so
    later joins get exchanges that adaptive execution may split when a key is hot."""
    ready_for_texts(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` gave, after the last job that reads them."""
    for t in tables:
        if getattr(t, "_scratch_path", None):
            discard(t.sparkSession, t._scratch_path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names compare as Spark does)."""
    return df.drop(*names)


def quoted(name: str) -> Column:
    """Column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(df: DataFrame) -> DataFrame:
    """``df`` with plain column names, by position: names with dots do not pass through Python."""
    return df.toDF(*[f"__own_{i}" for i in range(len(df.columns))])


def add_columns(df: DataFrame, fields: list[T.StructField], rows: Callable, needs: list[str]) -> DataFrame:
    """Append ``fields`` to every row of ``df``. ``rows(*columns)`` runs inside the tasks on the
    Python lists of the needed columns of one Arrow batch and gives one list per field; the other
    columns pass through untouched. Columns of the same names are replaced."""
    ready_for_texts(df.sparkSession)
    base = without(df, [f.name for f in fields])
    own, at = shielded(base), [base.columns.index(n) for n in needs]
    schema = T.StructType(list(own.schema.fields) + fields)
    added = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = rows(*[b.column(i).to_pylist() for i in at])
            arrays = list(b.columns) + [pa.array(c, type=f.type) for c, f in zip(cols, added)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        b = cols = arrays = None
        give_back()

    return own.mapInArrow(run, schema).toDF(*base.columns, *[f.name for f in fields])

"""Readers: CSV with null tokens and type sniffing, plain CSV, parquet, JDBC, dispatch by
extension, and multi-file extraction with missing files skipped."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.sinks import CSV_QUOTING

# Text tokens read as null.
NULL_TOKENS = ["", "NULL", "null", "N/A", "n/a"]

BAD_SHARE = 0.05  # what ``bad_share`` is unless given


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _null_tokens(c: str, tokens) -> F.Column:
    col = F.col(_name(c))
    return F.when(col.isin(tokens), F.lit(None).cast("string")).otherwise(col)


def _csv(spark: SparkSession, multi_line: bool):
    """Quotes are doubled inside quoted fields. With ``multi_line`` a quoted field may hold line
    breaks, which leaves one task per file; without, large files are split."""
    return spark.read.option("header", True).options(**CSV_QUOTING).option("multiLine", multi_line)


def read_csv_nulls(spark: SparkSession, path: str, tokens=None, date_format: str = "yyyy-MM-dd",
                   schema: T.StructType | None = None, multi_line: bool = True,
                   bad_share: float = BAD_SHARE) -> DataFrame:
    """CSV with several null tokens, bad values → null, and date/number sniffing.

    With a declared ``schema`` each column is ``try_cast`` to its type (no sniffing pass).
    Otherwise one aggregate pass over all columns decides, per column, the narrowest of
    bigint / double / date / string that its non-null values parse as; up to ``bad_share`` of
    them may not, and become null. With 0 a column that holds one bad value stays text, so that
    nothing is lost.
    """
    tokens = NULL_TOKENS if tokens is None else tokens
    raw = (_csv(spark, multi_line).option("inferSchema", False)
           .option("nullValue", None).option("emptyValue", "")
           .option("mode", "PERMISSIVE").csv(path))
    cols = raw.columns
    text = raw.select([_null_tokens(c, tokens).alias(c) for c in cols])
    if schema is not None:
        return text.select([_parsed(F.col(_name(f.name)), f.dataType.simpleString(), date_format).alias(f.name)
                            for f in schema.fields])
    # cheap necessary-condition patterns run first, so the parsers (which signal failure by
    # exceptions) only see values that can plausibly parse
    checks = []
    for i, c in enumerate(cols):
        v = F.col(_name(c))
        checks += [F.count(v).alias(f"n{i}"),
                   *[F.count(_parsed(v, t, date_format)).alias(f"{t}{i}") for t in SNIFFED]]
    stats = text.agg(*checks).first().asDict()  # one row of counts: bounded by column count
    out = []
    for i, c in enumerate(cols):
        n = stats[f"n{i}"]
        fit = [t for t in SNIFFED if n and stats[f"{t}{i}"] >= n * (1 - bad_share)]
        # doubles cover integers: the narrower type must lose nothing that the wider one keeps
        if "bigint" in fit and stats[f"double{i}"] > stats[f"bigint{i}"]:
            fit.remove("bigint")
        v = F.col(_name(c))
        out.append((_parsed(v, fit[0], date_format) if fit else v).alias(c))
    return text.select(out)


SNIFFED = ["bigint", "double", "date"]
MAYBE_NUMBER = r"^\s*[+-]?(\d|\.\d|[Ii][Nn][Ff]|[Nn][Aa][Nn])"
DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def _parsed(v: F.Column, kind: str, date_format: str) -> F.Column:
    """``v`` as ``kind``, null where it does not parse."""
    if kind in ("bigint", "double"):
        return F.when(v.rlike(MAYBE_NUMBER), v.try_cast(kind))
    if kind == "date":
        shaped = v.rlike(DATE_SHAPE) if date_format == "yyyy-MM-dd" else v.isNotNull()
        return F.when(shaped, F.try_to_date(v, date_format))
    return v.try_cast(kind)


def read_csv_plain(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Plain CSV with a header and Spark's own type inference (one extra pass)."""
    return _csv(spark, multi_line).option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_database(spark: SparkSession, url: str, query: str, properties: dict | None = None,
                  partition_column: str | None = None, lower: int | None = None,
                  upper: int | None = None, num_partitions: int = 8) -> DataFrame:
    """JDBC read; with ``partition_column`` the scan is split into ``num_partitions`` ranges."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("dbtable", f"({query}) q")
                  .option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    else:
        reader = reader.option("query", query)
    return reader.load()


def read_any(spark: SparkSession, source: str, db_url: str | None = None,
             db_query: str = "SELECT * FROM hr_employees", **csv_options) -> DataFrame:
    """Dispatch on the extension: csv / parquet; anything else is a database source.
    ``csv_options`` go to ``read_csv_nulls``: ``multi_line=False`` lets large files be split."""
    if source.endswith(".csv"):
        return read_csv_nulls(spark, source, **csv_options)
    if source.endswith(".parquet"):
        return read_parquet(spark, source)
    if db_url is None:
        raise ValueError(f"unsupported source (no database configured): {source}")
    return read_database(spark, db_url, db_query)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop filesystem of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def extract_tables(spark: SparkSession, sources: dict[str, str], **csv_options) -> dict[str, DataFrame]:
    """One DataFrame per existing source, named by the file stem; missing files are skipped,
    other read errors propagate. ``csv_options`` as in ``read_any``."""
    out = {}
    for name, path in sources.items():
        if not path_exists(spark, path):
            continue
        stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0] or name
        out[stem] = read_any(spark, path, **csv_options)
    return out

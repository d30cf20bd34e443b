"""Sinks: landing / curated parquet zones, CSV text, JSON event frames, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


# Quoting of CSV fields, the same for writers and readers (a quote is doubled).
CSV_QUOTING = {"quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; whitespace kept as is (Spark's writer trims by default), fields that hold
    commas, quotes or line breaks quoted."""
    (df.write.mode(mode).option("header", True).options(**CSV_QUOTING)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_landing(df: DataFrame, path: str) -> None:
    """Raw-zone landing: overwrite the table's parquet folder."""
    df.write.mode("overwrite").parquet(path)


def write_curated(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Curated-zone write, optionally partitioned (e.g. expenses by fiscal_year)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = rebalanced(df, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    w.parquet(path)


def rebalanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` gathered by ``keys`` for few files a folder, where a key with much data is split over
    as many tasks as its size asks for (the rebalance hint, sized by adaptive execution)."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def encode_events(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """Message frame (key, value): value = JSON of the whole row, key as string or null."""
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def publish(df: DataFrame, bootstrap: str, topic: str) -> None:
    """Batch publish of an encoded frame to a Kafka topic (needs the Kafka connector jar)."""
    (df.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
       .option("topic", topic).save())


def summary_to_docs(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Render a summary table as CSV text lines for indexing: one document per row, numbers to
    2 decimals, values quoted where CSV needs it, with the header line attached to each row."""
    def quoted(c):
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float", "decimal"):
            # a total too large for the decimal keeps its plain form
            c = F.coalesce(c.try_cast("decimal(38,2)").cast("string"), c.cast("string"))
        fields.append(F.coalesce(quoted(c.cast("string")), F.lit("")))
    header = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '",\n') else c for c in df.columns)
    return df.select(*[F.col(c) for c in (order_by or [])],
                     F.lit(header).alias("header"),
                     F.concat_ws(",", *fields).alias("line"))


def run_summary(df: DataFrame, source: str, target: str, as_of: str) -> DataFrame:
    """Completion event: records processed observed while the job's own action runs."""
    obs = Observation("run")
    observed = df.observe(obs, F.count(F.lit(1)).alias("records_processed"))
    observed.write.format("noop").mode("overwrite").save()  # the job's single action
    n = obs.get["records_processed"]
    spark = df.sparkSession
    return spark.createDataFrame(
        [(source, target, int(n), as_of)],
        "source string, target string, records_processed bigint, timestamp string",
    ).withColumn("timestamp", F.to_timestamp_ntz("timestamp"))

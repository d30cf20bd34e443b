"""Data-quality suites evaluated in one pass.

All value expectations of a table (not null, between, regex, in set) become ``count_if``
aggregates of a single ``agg``; each unique-column expectation adds one group-by on that
column (map-side partial counts, so a hot value costs one row per task). Column existence
is a schema check. The result is a tall table (expectation, column, evaluated, unexpected,
success); a gate over several suites raises before any load when one fails.

Semantics kept from the expectation library: value checks ignore nulls, bounds are
inclusive, and ``unique`` flags every row whose value occurs more than once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import EMAIL_LOOSE, EMAIL_STRICT


@dataclass(frozen=True)
class Expectation:
    kind: str  # exists | not_null | unique | between | regex | in_set | max_length
    column: str
    params: dict = field(default_factory=dict)


def _value_check(e: Expectation):
    c = F.col(e.column)
    if e.kind == "not_null":
        return F.count(F.lit(1)), F.count_if(c.isNull())
    nn = c.isNotNull()
    if e.kind == "between":
        bad = nn & ~c.between(e.params["min"], e.params["max"])
    elif e.kind == "regex":
        bad = nn & ~c.rlike(e.params["pattern"])
    elif e.kind == "in_set":
        bad = nn & ~c.isin(list(e.params["values"]))
    elif e.kind == "max_length":
        bad = nn & (F.length(c) > e.params["max"])
    else:
        raise ValueError(e.kind)
    return F.count_if(nn), F.count_if(bad)


def run_suite(df: DataFrame, expectations: list[Expectation], table: str) -> DataFrame:
    spark = df.sparkSession
    present = set(df.columns)
    rows_schema = "table_name string, expectation string, column_name string, ord int, evaluated bigint, unexpected bigint"
    parts = []
    exists = [(table, "expect_column_to_exist", e.column, i, 1, 0 if e.column in present else 1)
              for i, e in enumerate(expectations) if e.kind == "exists"]
    if exists:
        parts.append(spark.createDataFrame(exists, rows_schema))
    value = [(i, e) for i, e in enumerate(expectations)
             if e.kind not in ("exists", "unique") and e.column in present]
    if value:
        aggs = []
        for i, e in value:
            ev, bad = _value_check(e)
            aggs += [ev.alias(f"e{i}"), bad.alias(f"u{i}")]
        one = df.agg(*aggs)
        names = {"not_null": "expect_column_values_to_not_be_null",
                 "between": "expect_column_values_to_be_between",
                 "regex": "expect_column_values_to_match_regex",
                 "in_set": "expect_column_values_to_be_in_set",
                 "max_length": "expect_column_value_lengths_to_be_between"}
        tall = one.select(F.explode(F.array(*[
            F.struct(F.lit(table).alias("table_name"), F.lit(names[e.kind]).alias("expectation"),
                     F.lit(e.column).alias("column_name"), F.lit(i).alias("ord"),
                     F.col(f"e{i}").cast("bigint").alias("evaluated"),
                     F.col(f"u{i}").cast("bigint").alias("unexpected")) for i, e in value])).alias("r"))
        parts.append(tall.select("r.*"))
    for i, e in enumerate(expectations):
        if e.kind == "unique" and e.column in present:
            parts.append(unique_check(df, e.column).select(
                F.lit(table).alias("table_name"), F.lit("expect_column_values_to_be_unique").alias("expectation"),
                F.lit(e.column).alias("column_name"), F.lit(i).alias("ord"), "evaluated", "unexpected"))
    missing = [(table, f"column_missing:{e.kind}", e.column, i, 0, 1)
               for i, e in enumerate(expectations) if e.kind != "exists" and e.column not in present]
    if missing:
        parts.append(spark.createDataFrame(missing, rows_schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("success", F.col("unexpected") == 0)


def unique_check(df: DataFrame, column: str) -> DataFrame:
    """(evaluated = non-null rows, unexpected = rows whose value occurs more than once)."""
    per_value = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("evaluated"),
                         F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint")
                         .alias("unexpected"))


def duplicate_report(df: DataFrame, column: str, table: str) -> DataFrame:
    """Rows that share their value and values that are shared. Values are grouped by a 128-bit hash,
    so that long texts do not travel as keys."""
    key = F.struct(F.md5(F.col(column).cast("string")).alias("h"), F.xxhash64(column).alias("x"))
    per_value = df.filter(F.col(column).isNotNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_values")).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "duplicate_rows", "duplicated_values")


# The HR suite.
DEPARTMENTS = ["engineering", "finance", "hr", "marketing", "sales", "operations"]
STATUSES = ["active", "inactive", "terminated", "on_leave"]

HR_SUITE = [
    Expectation("exists", "employee_id"), Expectation("not_null", "employee_id"),
    Expectation("unique", "employee_id"),
    Expectation("exists", "first_name"), Expectation("exists", "last_name"),
    Expectation("not_null", "first_name"), Expectation("not_null", "last_name"),
    Expectation("exists", "email"), Expectation("regex", "email", {"pattern": EMAIL_STRICT}),
    Expectation("exists", "salary"), Expectation("between", "salary", {"min": 0, "max": 1_000_000}),
    Expectation("between", "performance_rating", {"min": 0.0, "max": 5.0}),
    Expectation("in_set", "department", {"values": DEPARTMENTS}),
    Expectation("in_set", "status", {"values": STATUSES}),
]

# The load-gate suites per curated table.
GATE_SUITES = {
    "transformed_employees": [
        Expectation("exists", "employee_id"), Expectation("not_null", "employee_id"),
        Expectation("unique", "employee_id"), Expectation("regex", "email", {"pattern": EMAIL_LOOSE}),
        Expectation("between", "salary", {"min": 0, "max": 1_000_000})],
    "transformed_performance_reviews": [
        Expectation("between", "rating", {"min": 1.0, "max": 5.0}), Expectation("exists", "employee_id")],
    "department_summary": [],
}


def suite_summary(results: DataFrame, as_of: str | None = None) -> DataFrame:
    """Per table: success, the failed expectation types in suite order, and when it was judged."""
    at = F.to_timestamp_ntz(F.lit(as_of)) if as_of else F.localtimestamp()
    return results.groupBy("table_name").agg(
        F.bool_and("success").alias("success"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("ord", "expectation")))),
                    lambda s: s["expectation"]).alias("failed_expectations")).withColumn("timestamp", at)


def gate(results: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Per table PASSED / FAILED. Of ``tables``, those without any expectation pass."""
    if tables:
        names = results.sparkSession.createDataFrame([(t,) for t in tables], "table_name string")
        results = results.select("table_name", "success").unionByName(names.withColumn("success", F.lit(True)))
    return results.groupBy("table_name").agg(
        F.count_if(~F.col("success")).alias("failed_checks")).select(
        "table_name", "failed_checks",
        F.when(F.col("failed_checks") > 0, "FAILED").otherwise("PASSED").alias("status"))


def enforce(gate_df: DataFrame) -> None:
    """Raise before loading anything when a table failed (reads only the small gate table)."""
    failed = [r["table_name"] for r in gate_df.filter(F.col("status") == "FAILED").select("table_name").collect()]
    if failed:
        raise ValueError(f"nothing is loaded, checks failed on: {', '.join(sorted(failed))}")


# Required employee columns and accepted types.
REQUIRED_EMPLOYEE_COLUMNS = ["employee_id", "first_name", "last_name", "email", "department",
                             "salary", "hire_date"]
EXPECTED_EMPLOYEE_TYPES = {"employee_id": ["bigint", "int"], "salary": ["double", "bigint"],
                           "performance_rating": ["double"]}


def schema_check(df: DataFrame) -> DataFrame:
    """(level, message) rows: missing required columns → error, unexpected types → warning."""
    present = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    missing = [c for c in REQUIRED_EMPLOYEE_COLUMNS if c not in present]
    if missing:
        rows.append(("error", f"columns not found: {', '.join(sorted(missing))}"))
    for c, ok in EXPECTED_EMPLOYEE_TYPES.items():
        if c in present and present[c] not in ok:
            rows.append(("warning", f"{c} is {present[c]}, not {' or '.join(ok)}"))
    schema = T.StructType([T.StructField("level", T.StringType()), T.StructField("message", T.StringType())])
    return df.sparkSession.createDataFrame(rows, schema)


def business_rules(df: DataFrame, as_of: str) -> DataFrame:
    """Counts per rule in one pass: non-positive salary, rating outside 1-5, bad e-mail
    (errors) and hire date after ``as_of`` (warning)."""
    one = df.agg(
        F.count_if(F.col("salary") <= 0).alias("non_positive_salary"),
        F.count_if((F.col("performance_rating") < 1.0) | (F.col("performance_rating") > 5.0)).alias("invalid_rating"),
        F.count_if(~F.col("email").rlike(EMAIL_STRICT)).alias("invalid_email"),
        F.count_if(F.col("hire_date") > F.to_date(F.lit(as_of))).alias("future_hire"))
    rules = [("non_positive_salary", "error"), ("invalid_rating", "error"), ("invalid_email", "error"),
             ("future_hire", "warning")]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(lvl).alias("level"), F.col(r).cast("bigint").alias("violations"))
        for r, lvl in rules])).alias("x")).select("x.*")


def constraint_checks(checks: list[tuple], tables: dict[str, DataFrame]) -> DataFrame:
    """Warehouse constraints as checks. ``checks`` rows: (name, kind, table, column, arg) with
    kind pk | unique | not_null | fk (arg = 'table.column') | max_length (arg = n).

    All row checks of a table are one aggregate over it. Key checks of a column share one count
    per value; a foreign key joins those counts, one row per value, with the parent's keys.
    """
    counts: dict[tuple[str, str], DataFrame] = {}

    def per_value(table, column):
        if (table, column) not in counts:
            counts[table, column] = tables[table].groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counts[table, column]

    parts = []
    for table in dict.fromkeys(c[2] for c in checks):
        own = [c for c in checks if c[2] == table]
        rows = {n: _row_check(k, col, a) for n, k, _, col, a in own if k in ("not_null", "max_length")}
        rows |= {f"{n} nulls": F.count_if(F.col(col).isNull()) for n, k, _, col, _ in own if k == "pk"}
        if rows:
            names = list(rows)
            one = tables[table].agg(*[rows[n].cast("bigint").alias(f"c{i}") for i, n in enumerate(names)])
            parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n.split(" ")[0]).alias("constraint_name"), F.col(f"c{i}").alias("violations"))
                                                        for i, n in enumerate(names)])).alias("r")).select("r.*"))
        for name, kind, _, column, arg in own:
            if kind in ("pk", "unique"):
                bad = per_value(table, column).filter("v is not null and n > 1")
            elif kind == "fk":
                parent_table, parent_col = arg.split(".")
                keys = tables[parent_table].select(F.col(parent_col).alias("v")).distinct()
                bad = per_value(table, column).filter("v is not null").join(keys, "v", "left_anti")
            else:
                continue
            parts.append(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations")).select(
                F.lit(name).alias("constraint_name"), "violations"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = found.sparkSession.createDataFrame([c[:4] for c in checks], "constraint_name string, kind string, table_name string, column_name string")
    total = found.groupBy("constraint_name").agg(F.sum("violations").alias("violations"))
    # one row per constraint
    return names.join(F.broadcast(total), "constraint_name").withColumn("satisfied", F.col("violations") == 0)


def _row_check(kind: str, column: str, arg):
    return F.count_if(F.col(column).isNull()) if kind == "not_null" else F.count_if(F.length(F.col(column)) > int(arg))

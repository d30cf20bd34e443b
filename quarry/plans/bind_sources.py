"""Source and sink bindings (A1-A12, A16-A18): each writes a fixture view to a fresh folder
under the shared checkpoint directory and reads it back through the library reader."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import cleaning as cl
from quarry.operators import keyed
from quarry.operators import summaries as sm
from quarry.plans import fixtures as fx
from quarry.plans.bind_hr import CLEAN_SQL, clean_employees_df, employees_with_tenure
from quarry.plans.catalog import query
from quarry.session import scratch_path
from quarry.sources import readers as rd
from quarry.sources import sinks as sk

NULLED = "CASE WHEN {c} IN ('', 'NULL', 'null', 'N/A', 'n/a') THEN NULL ELSE {c} END"


def _nulled(c):
    return NULLED.format(c=c)


# Columns that ordinary CSV files have and plain splitting breaks: quotes, commas, line breaks, a
# dotted name, blanks around values, and numbers and dates with a few bad values among them.
CSV_EXTRA = {
    "notes": "CASE employee_id % 5 WHEN 0 THEN 'say \"hi\", ok' WHEN 1 THEN concat('two', chr(10), 'lines, \"x\"') WHEN 2 THEN '\"' WHEN 3 THEN NULL ELSE ' plain ' END",
    "home.city": "concat('City, ', CAST(employee_id % 9 AS string))",
    "grade": "CASE WHEN employee_id % 97 = 5 THEN '7?' ELSE CAST(employee_id % 11 AS string) END",
}


def _extra_sql(quote: str) -> str:
    return ", ".join(f"{body} AS {quote}{name}{quote}" for name, body in CSV_EXTRA.items())


def _write_employees_csv(spark, sf):
    path = scratch_path(spark, "employees_csv")
    raw = fx.table(spark, sf, "employees_raw")
    sk.write_csv(raw.selectExpr("*", *[f"{body} AS `{name}`" for name, body in CSV_EXTRA.items()]), path)
    return path


CSV_SQL = fx.cte("employees_raw")[:-1] + f""",
file AS (SELECT *, {_extra_sql('"')} FROM employees_raw)
"""


def _csv_nulls_sql() -> str:
    return CSV_SQL + f"""SELECT employee_id,
  {_nulled('first_name')} AS first_name, {_nulled('last_name')} AS last_name,
  {_nulled('email')} AS email, {_nulled('department')} AS department,
  TRY_CAST({_nulled('salary')} AS DOUBLE) AS salary,
  performance_rating, TRY_CAST({_nulled('hire_date')} AS DATE) AS hire_date, {_nulled('status')} AS status,
  birth_date, notes, "home.city", TRY_CAST(grade AS BIGINT) AS grade
FROM file"""


@query("csv_scan_nulls", _csv_nulls_sql())
def q_csv_nulls(spark, sf):
    return rd.read_csv_nulls(spark, _write_employees_csv(spark, sf))


@query("csv_scan_schema", CSV_SQL + f"""SELECT CAST(employee_id AS INTEGER) AS employee_id, notes, TRY_CAST(grade AS DOUBLE) AS grade,
  TRY_CAST({_nulled('hire_date')} AS DATE) AS hire_date, CAST(NULL AS BIGINT) AS status FROM file""")
def q_csv_schema(spark, sf):
    """A declared schema: values that do not parse as their column's type are null."""
    return rd.read_csv_nulls(spark, _write_employees_csv(spark, sf), schema=T._parse_datatype_string(
        "employee_id int, notes string, grade double, hire_date date, status bigint"))


@query("csv_scan_plain", CSV_SQL + """SELECT CAST(employee_id AS INTEGER) AS employee_id,
  first_name, last_name, email, department, NULLIF(salary, '') AS salary, performance_rating, hire_date,
  status, birth_date, notes, "home.city", grade
FROM file""")
def q_csv_plain(spark, sf):
    # plain read: Spark's own inference; an empty field is null, blanks around values are kept
    return rd.read_csv_plain(spark, _write_employees_csv(spark, sf))


@query("parquet_scan", fx.cte("employees_raw") + """SELECT employee_id, email, salary
FROM employees_raw WHERE employee_id >= 100""")
def q_parquet_scan(spark, sf):
    path = scratch_path(spark, "employees_parquet")
    sk.write_landing(fx.table(spark, sf, "employees_raw"), path)
    # projection and filter reach the scan: ReadSchema has 3 columns, PushedFilters the bound
    return rd.read_parquet(spark, path).select("employee_id", "email", "salary").filter(
        F.col("employee_id") >= 100)


@query("multi_extract_counts", fx.cte("employees_raw", "expenses_raw", "departments") + """
SELECT 'employees' AS table_name, count(*) AS row_count FROM employees_raw
UNION ALL SELECT 'expenses', count(*) FROM expenses_raw
UNION ALL SELECT 'departments', count(*) FROM departments""")
def q_multi_extract(spark, sf):
    base = scratch_path(spark, "extract")
    sources = {}
    for name, kind in [("employees", "csv"), ("expenses", "parquet"), ("departments", "parquet")]:
        view = {"employees": "employees_raw", "expenses": "expenses_raw"}.get(name, name)
        path = os.path.join(base, f"{name}.{kind}")
        df = fx.table(spark, sf, view)
        if kind == "csv":
            sk.write_csv(df, path)
        else:
            sk.write_landing(df, path)
        sources[name] = path
    sources["revenue"] = os.path.join(base, "revenue.csv")  # declared but absent: skipped
    tables = rd.extract_tables(spark, sources)
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


@query("read_any_dispatch", fx.cte("employees_raw") + """
SELECT 'csv' AS fmt, count(*) AS row_count, CAST(sum(employee_id) AS BIGINT) AS id_sum FROM employees_raw
UNION ALL SELECT 'parquet', count(*), CAST(sum(employee_id) AS BIGINT) FROM employees_raw""")
def q_read_any(spark, sf):
    base = scratch_path(spark, "employees_any")
    csv_path, pq_path = os.path.join(base, "employees.csv"), os.path.join(base, "employees.parquet")
    sk.write_csv(fx.table(spark, sf, "employees_raw"), csv_path)
    sk.write_landing(fx.table(spark, sf, "employees_raw"), pq_path)
    parts = []
    for fmt, path in [("csv", csv_path), ("parquet", pq_path)]:
        df = rd.read_any(spark, path)  # reader chosen by the extension
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count"), F.sum("employee_id").alias("id_sum"))
                     .select(F.lit(fmt).alias("fmt"), "row_count", "id_sum"))
    return parts[0].unionByName(parts[1])


@query("landing_roundtrip", fx.cte("employees_raw") + "SELECT * FROM employees_raw")
def q_landing(spark, sf):
    path = os.path.join(scratch_path(spark, "raw"), "raw_employees.parquet")
    sk.write_landing(fx.table(spark, sf, "employees_raw"), path)
    return rd.read_parquet(spark, path)


def _curated_sql():
    from quarry.plans.bind_finance import EXP_CLEAN_SQL
    return EXP_CLEAN_SQL + "SELECT * FROM exp_clean"


@query("curated_roundtrip", _curated_sql())
def q_curated(spark, sf):
    path = os.path.join(scratch_path(spark, "curated"), "transformed_expenses.parquet")
    sk.write_curated(cl.clean_expenses(fx.table(spark, sf, "expenses_raw")), path, ["fiscal_year"])
    return rd.read_parquet(spark, path)


UPSERT_KEYS = {"departments": "department_id", "clean": "employee_id", "exp_clean": "expense_id", "budgets_raw": "budget_id",
               "budget_allocations": "allocation_id", "performance_reviews_raw": "review_id"}


def _upsert_sql() -> str:
    """The six warehouse tables: a tenth of the keys come in again, twice each, with a load number."""
    from quarry.plans.bind_finance import EXP_CLEAN_SQL
    views = CLEAN_SQL[:-1] + ",\n" + EXP_CLEAN_SQL[5:-1] + ",\n" + fx.cte(
        "departments", "budgets_raw", "budget_allocations", "performance_reviews_raw")[5:]
    return views + "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({k} AS BIGINT) AS key, CASE WHEN {k} % 10 = 0 THEN 2 ELSE 0 END AS load FROM {t}"
        for t, k in UPSERT_KEYS.items())


@query("warehouse_upsert", _upsert_sql())
def q_upsert(spark, sf):
    out = None
    for name, key in UPSERT_KEYS.items():
        target = _warehouse_table(spark, sf, name).withColumn("load", F.lit(0))
        again = target.filter(F.col(key) % 10 == 0).withColumn("load", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))))
        rows = keyed.upsert(target, again, [key], order=["load"]).select(
            F.lit(name).alias("table_name"), F.col(key).cast("long").alias("key"), "load")
        out = rows if out is None else out.unionByName(rows)
    return out


def _warehouse_table(spark, sf, name):
    if name == "clean":
        return clean_employees_df(spark, sf)
    if name == "exp_clean":
        return cl.clean_expenses(fx.table(spark, sf, "expenses_raw"))
    return fx.table(spark, sf, name)


@query("summary_to_docs", CLEAN_SQL + """SELECT department,
  'department,headcount,avg_salary,avg_tenure,total_payroll' AS header,
  concat_ws(',', coalesce(department, ''), CAST(headcount AS VARCHAR),
    coalesce(CAST(CAST(avg_salary AS DECIMAL(18,2)) AS VARCHAR), ''),
    coalesce(CAST(CAST(avg_tenure AS DECIMAL(18,2)) AS VARCHAR), ''),
    coalesce(CAST(CAST(total_payroll AS DECIMAL(18,2)) AS VARCHAR), '')) AS line
FROM (SELECT department, count(employee_id) AS headcount,
  round(avg(salary), 6) AS avg_salary, round(avg(tenure_years), 6) AS avg_tenure,
  round(sum(salary), 2) AS total_payroll FROM tenure GROUP BY department)""")
def q_summary_docs(spark, sf):
    return sk.summary_to_docs(sm.department_summary(employees_with_tenure(spark, sf)),
                              order_by=["department"])


@query("run_summary", CLEAN_SQL + f"""SELECT 'employees_raw' AS source, 'hr_employees' AS target,
  count(*) AS records_processed, TIMESTAMP '{fx.AS_OF} 00:00:00' AS timestamp FROM tenure""")
def q_run_summary(spark, sf):
    return sk.run_summary(employees_with_tenure(spark, sf), "employees_raw", "hr_employees",
                          f"{fx.AS_OF} 00:00:00")


@query("doc_insert_absent", """WITH old AS (SELECT lang AS collection, d.* FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)),
new AS (SELECT lang AS collection, d.* FROM documents d WHERE d.doc_id IN (SELECT vec_id FROM embeddings))
SELECT collection, doc_id, text, lang, source, n_chars FROM old
UNION ALL SELECT collection, doc_id, text, lang, source, n_chars FROM new
WHERE doc_id NOT IN (SELECT doc_id FROM old)
UNION ALL SELECT 'all' AS collection, doc_id, text, lang, source, n_chars FROM new""")
def q_insert_absent(spark, sf):
    """The store holds the labelled documents; a batch of embedded documents is added twice over,
    to their own collection and to one that holds none yet. The key is collection and id, so
    existing ids keep their stored row in their own collection only."""
    docs = fx.table(spark, sf, "documents").select(F.col("lang").alias("collection"), "*")
    old = docs.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    own = docs.join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(docs.columns)
    new = own.unionByName(own).unionByName(own.withColumn("collection", F.lit("all")))
    return keyed.insert_if_absent(old, new, ["collection", "doc_id"])


@query("doc_delete", """WITH store AS (SELECT lang AS collection, d.* FROM documents d UNION ALL SELECT 'all' AS collection, d.* FROM documents d)
SELECT s.* FROM store s
WHERE NOT (s.collection = s.lang AND s.doc_id IN (SELECT doc_id FROM labels l WHERE l.toxic = 1))""")
def q_doc_delete(spark, sf):
    """Flagged documents leave their own collection; the collection of all documents, under the same
    ids, keeps them. The key is collection and id, and keys are listed twice over."""
    docs = fx.table(spark, sf, "documents")
    store = docs.select(F.col("lang").alias("collection"), "*").unionByName(docs.select(F.lit("all").alias("collection"), "*"))
    flagged = docs.join(fx.table(spark, sf, "labels").filter(F.col("toxic") == 1), "doc_id", "left_semi").select(
        F.col("lang").alias("collection"), "doc_id")
    return keyed.delete_keys(store, flagged.unionByName(flagged), ["collection", "doc_id"]).select(store.columns)

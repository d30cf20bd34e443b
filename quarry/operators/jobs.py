"""Composite batch jobs: schema-version ledger, the HR extract → clean → validate → load
job with its completion event, the two-domain daily job, and the overview analyses."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import cleaning as cl
from quarry.operators import quality as dq
from quarry.operators import summaries as sm
from quarry.session import reliable_checkpoint
from quarry.sources import readers as rd
from quarry.sources import sinks as sk
from quarry.sources import store


def pending_versions(available: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    """Available versions not applied yet, in version order."""
    return available.join(applied.select(key), key, "left_anti").orderBy(key)


def version_status(available: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    """Every available version with applied/pending status and the totals of both (the
    ledger has one row per schema version, so the total window is over a small table)."""
    marked = available.join(applied.select(key).withColumn("__a", F.lit(True)), key, "left")
    status = F.when(F.col("__a"), "applied").otherwise("pending")
    w = Window.partitionBy()
    return marked.select(*available.columns, status.alias("status")).withColumns({
        "total_applied": F.count_if(F.col("status") == "applied").over(w),
        "total_pending": F.count_if(F.col("status") == "pending").over(w)})


def load_table(source: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> int:
    """Keyed replace of ``source`` into the table ``path``, the last part of which is its name in the
    store of the rest (see ``store``): one row per key, new keys added, others kept. Only the buckets
    of the keys are written, and the table changes at once or not at all. Returns its rows afterwards."""
    root, name = os.path.split(path.rstrip("/"))
    return store.load(source, root, name, keys, order)


def hr_job(raw: DataFrame | str, as_of: str, target_path: str | None, source: str, target: str,
           spark: SparkSession | None = None) -> DataFrame:
    """Extract (a table, or a path read by its extension) → clean → tenure → validate → (load by
    key, only when valid) → completion event.

    The cleaned table is checkpointed once and counted on the way, so validation and load read the
    same rows and a lost executor recomputes nothing upstream. Returns the one-row event.
    """
    table = rd.read_any(spark, raw) if isinstance(raw, str) else raw
    seen = Observation("hr")
    cleaned = reliable_checkpoint(cl.tenure_years(cl.clean_employees(table), as_of).observe(seen, F.count(F.lit(1)).alias("n")))
    row = dq.run_suite(cleaned, dq.HR_SUITE, "employees").agg(
        F.bool_and("success").alias("ok"), F.count_if(~F.col("success")).alias("failed")).first()  # two numbers
    loaded = bool(row["ok"] and target_path)
    if loaded:
        load_table(cleaned, target_path, ["employee_id"])
    return table.sparkSession.createDataFrame(
        [(source, target, int(seen.get["n"]), bool(row["ok"]), int(row["failed"]), loaded, as_of)],
        "source string, target string, records_processed bigint, validation_success boolean, "
        "failed_expectations int, loaded boolean, timestamp string",
    ).withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


# The daily job's tables in load order, with their keys.
DAILY_KEYS = {"employees": ["employee_id"], "performance_reviews": ["review_id"], "expenses": ["expense_id"],
              "budgets": ["budget_id"], "department_summary": ["department"], "expense_summary": ["category"]}
DAILY_REPORT = ("execution_date string, validation string, tables_passed int, tables_loaded int, rows_loaded bigint, "
                "summaries_indexed int, lines_indexed bigint, summary string")


def daily_transform(tables: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """The curated tables from the extracted ones; what was not extracted has none."""
    out = {}
    if "employees" in tables:
        out["employees"] = reliable_checkpoint(cl.tenure_years(cl.clean_employees(tables["employees"]), as_of))
        out["department_summary"] = sm.department_summary(out["employees"])
    if "performance_reviews" in tables:
        out["performance_reviews"] = cl.clean_reviews(tables["performance_reviews"])
    if "expenses" in tables:
        out["expenses"] = reliable_checkpoint(cl.clean_expenses(tables["expenses"]))
        out["expense_summary"] = sm.expense_summary(out["expenses"])
    if "budgets" in tables:
        out["budgets"] = cl.budget_utilization(tables["budgets"])
    return out


def daily_gate(curated: dict[str, DataFrame]) -> DataFrame:
    """Gate status of every gated table that is there."""
    results, names = None, []
    for name, suite in dq.GATE_SUITES.items():
        table = curated.get(name.replace("transformed_", ""))
        if table is None:
            continue
        names.append(name)
        part = dq.run_suite(table, suite, name) if suite else None
        results = part if results is None else results.unionByName(part) if part is not None else results
    return dq.gate(results, names)


def daily_job(spark: SparkSession, sources: dict[str, str], warehouse: str, as_of: str) -> DataFrame:
    """Extract → transform → gate → load by key → index the summaries → one-row report.

    Nothing is written before the gate has passed: ``ValueError`` otherwise. All tables, and the
    summaries' CSV lines (tables ``index/...``), are staged first and published together, so a job that
    stops anywhere leaves the whole warehouse as it was.
    """
    curated = daily_transform(rd.extract_tables(spark, sources), as_of)
    status = reliable_checkpoint(daily_gate(curated))
    dq.enforce(status)
    passed = status.filter("status = 'PASSED'").count()
    base, _ = store.current(spark, warehouse)
    staged = [store.stage_rows(curated[name], warehouse, name, keys) for name, keys in DAILY_KEYS.items() if name in curated]
    rows = {t.name: t.rows for t in staged}
    lines = [store.stage_whole(sk.summary_to_docs(store.read_staged(spark, warehouse, t)), warehouse, f"index/{t.name}")
             for t in staged if t.name in ("department_summary", "expense_summary")]
    store.publish(spark, warehouse, staged + lines, base)
    indexed = len(lines)
    report = f"{as_of}: {passed} tables passed, {len(rows)} loaded, {indexed} summaries indexed"
    return spark.createDataFrame([(as_of, "PASSED", passed, len(rows), sum(rows.values()), indexed, sum(t.rows for t in lines), report)], DAILY_REPORT)


def employee_overview(emp: DataFrame) -> DataFrame:
    """Headcount and mean tenure per department and overall (rollup)."""
    return (emp.rollup("department").agg(F.count("employee_id").alias("headcount"),
                                         F.avg("tenure_years").alias("avg_tenure"),
                                         F.grouping("department").cast("int").alias("is_total")))


def performance_trend(reviews: DataFrame, employees: DataFrame) -> DataFrame:
    """Mean review rating per department and review quarter, change on the previous quarter
    of the same department, and the department's overall rank (1 = highest rated).

    Reviews are reduced to (employee, quarter) sums and counts before the join with the
    employee table; means are formed from the sums afterwards.
    """
    per_emp = reviews.groupBy(
        "employee_id", F.year("review_date").alias("year"), F.quarter("review_date").alias("quarter")).agg(
        F.sum("rating").alias("s"), F.count("rating").alias("n"), F.count(F.lit(1)).alias("rows"))
    j = per_emp.join(employees.select("employee_id", "department"), "employee_id")
    per_q = j.groupBy("department", "year", "quarter").agg(
        (F.sum("s") / F.sum("n")).alias("avg_rating"), F.sum("rows").alias("reviews"))
    overall = j.groupBy("department").agg((F.sum("s") / F.sum("n")).alias("dept_avg"))
    ranked = overall.withColumn("dept_rank", F.dense_rank().over(Window.orderBy(F.col("dept_avg").desc())))
    w = Window.partitionBy("department").orderBy("year", "quarter")
    return per_q.join(ranked, "department").select(
        "department", "year", "quarter", "reviews", "avg_rating",
        (F.col("avg_rating") - F.lag("avg_rating").over(w)).alias("change"), "dept_rank")


def dispatch(routed: DataFrame, route_col: str, registry: dict[str, str], default: str = "general") -> DataFrame:
    """The job that each routed row asks for: the registry's entry for its route, that of the
    default route where there is none."""
    table = F.create_map(*[F.lit(x) for kv in registry.items() for x in kv])
    return routed.withColumn("job", F.coalesce(F.element_at(table, F.col(route_col)), F.lit(registry[default])))


def invoke(routed: DataFrame, route_col: str, registry: dict[str, str], skills: dict[str, Callable[[DataFrame], DataFrame]],
           key: str, default: str = "general") -> DataFrame:
    """``(key, job, answer)``: every registered job is run once over all rows routed to it, a DataFrame
    job that gives ``(key, answer)``, and its answers go back to them; a row whose route is unknown or null
    goes to the default job, one that its job does not answer has a null answer. Rows with the same
    key share their answer."""
    sent = dispatch(routed, route_col, registry, default)
    out = None
    for job in sorted(set(registry.values())):
        own = sent.filter(F.col("job") == job)
        answers = skills[job](own).select(F.col(key).alias("__key"), F.col("answer").cast("string").alias("answer")).groupBy("__key").agg(F.max("answer").alias("answer"))
        part = own.select(key, "job").join(answers, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, "job", "answer")
        out = part if out is None else out.unionByName(part)
    return out

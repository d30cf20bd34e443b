"""Rule-based routing of question tables: domain, intent, answer confidence, admission,
and per-agent / per-model statistics over the query log. Rules are ordered substring tests
on the lower-cased text (so "hr" matches "three"), compiled into one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import contains_any, first_matching_label, strip_ws

# Routing rules of the orchestrator (first copy).
ORCHESTRATOR_RULES = [
    ("hr", ["employee", "performance", "leave", "recruitment", "payroll"]),
    ("finance", ["budget", "expense", "revenue", "cost", "profit"]),
    ("document", ["analyze", "summarize", "extract", "process"]),
]
# Routing rules of the agent (second copy).
AGENT_RULES = [
    ("hr", ["employee", "hr", "performance", "leave", "recruitment"]),
    ("finance", ["finance", "budget", "expense", "revenue", "cost"]),
    ("document", ["document", "analyze", "summarize", "extract"]),
]
# The short copy (no general fallback: anything else is a document question).
SHORT_RULES = [("hr", ["employee", "hr"]), ("finance", ["finance", "budget"])]
SHORT_DEFAULT = "document"

# Intent within a domain.
INTENT_RULES = {
    "hr": [("performance", ["performance"]), ("leave", ["leave"]),
           ("recruitment", ["recruitment", "hiring"]), ("compensation", ["salary", "compensation"]),
           ("employee_data", ["employee"])],
    "finance": [("budget", ["budget"]), ("expenses", ["expense"]), ("revenue", ["revenue", "income"]),
                ("costs", ["cost"]), ("financial_report", ["financial", "report"])],
    "document": [("summarize", ["summarize"]), ("extract", ["extract"]), ("analyze", ["analyze"]),
                 ("search", ["search"])],
}
INTENT_DEFAULTS = {"hr": "general_hr", "finance": "general_finance", "document": "general_document"}

# Confidence heuristic.
CONFIDENCE_BASE = 0.5
CONFIDENCE_LONG = 0.2          # response longer than 100 chars
CONFIDENCE_REPORT = 0.15       # report words present
CONFIDENCE_ERROR = -0.3        # error words present
REPORT_WORDS = ["analysis", "data", "report", "according to"]
ERROR_WORDS = ["error", "sorry"]


def route(df: DataFrame, text_col: str, rules=None, default: str = "general",
          out_col: str = "route") -> DataFrame:
    rules = rules or ORCHESTRATOR_RULES
    return df.withColumn(out_col, first_matching_label(F.lower(F.col(text_col)), rules, default))


def intent(df: DataFrame, text_col: str, domain_col: str = "route", out_col: str = "intent") -> DataFrame:
    low = F.lower(F.col(text_col))
    expr = None
    for domain, rules in INTENT_RULES.items():
        inner = first_matching_label(low, rules, INTENT_DEFAULTS[domain])
        cond = F.col(domain_col) == domain
        expr = F.when(cond, inner) if expr is None else expr.when(cond, inner)
    return df.withColumn(out_col, expr.otherwise(F.lit("general")))


def confidence(response: Column) -> Column:
    low = F.lower(response)
    score = (F.lit(CONFIDENCE_BASE)
             + F.when(F.length(response) > 100, CONFIDENCE_LONG).otherwise(0.0)
             + F.when(contains_any(low, REPORT_WORDS), CONFIDENCE_REPORT).otherwise(0.0)
             + F.when(contains_any(low, ERROR_WORDS), CONFIDENCE_ERROR).otherwise(0.0))
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def admission(df: DataFrame, text_col: str, max_len: int = 1000) -> DataFrame:
    """Admissible when non-blank and at most ``max_len`` chars (before stripping); the
    admitted text is stripped. Rejected rows carry the reason."""
    t = F.col(text_col)
    blank = t.isNull() | (strip_ws(t) == "")
    too_long = F.length(t) > max_len
    reason = F.when(blank, "empty").when(too_long, "too_long")
    return df.withColumns({"admitted": reason.isNull(), "reason": reason,
                           "clean_query": F.when(reason.isNull(), strip_ws(t))})


def agent_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("processing_time").alias("avg_processing_time"),
        F.avg("confidence").alias("avg_confidence"))


def model_metrics(log: DataFrame) -> DataFrame:
    """count, total, mean, last (by time, ties by id) and throughput = 1/mean (0 when mean 0)."""
    agg = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_inferences"),
        F.sum("processing_time").alias("total_time"),
        F.avg("processing_time").alias("avg_time"),
        F.max_by("processing_time", F.struct("ts", "query_id")).alias("last_time"))
    return agg.select("model", "total_inferences", "total_time",
                      "avg_time", "last_time",
                      (F.when(F.col("avg_time") > 0, 1 / F.col("avg_time")).otherwise(0.0)).alias("throughput"))

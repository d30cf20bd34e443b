
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


# Decimals at which computed doubles are compared with the oracle: sums and means of doubles
# depend on the order of addition in their last digits, money totals in more of them. Operators
# return what they compute; only the registered queries round.
DECIMALS = {
    "agent_metrics": {"avg_confidence": 6, "avg_processing_time": 6},
    "alert_breaches": {"value": 6},
    "budget_allocation": {"allocated_amount": 6, "budget_amount": 6, "spent_amount": 6},
    "budget_variance": {"total_allocated": 6, "total_budget": 6, "total_spent": 6, "variance": 6},
    "counter_rate": {"increase": 6, "rate_per_s": 6},
    "cost_per_employee": {"cost_per_employee": 6, "total_expense": 2},
    "dept_profile": {"avg_performance": 6, "avg_salary": 6, "median_salary": 6},
    "dept_salary": {"avg_performance": 6, "avg_salary": 6},
    "dept_salary_point": {"avg_salary": 6},
    "dept_summary": {"avg_salary": 6, "avg_tenure": 6, "total_payroll": 2},
    "doc_type_mix": {"percent": 6},
    "employee_overview": {"avg_tenure": 6},
    "error_ratio": {"error_ratio": 6},
    "expense_by_department": {"total_amount": 2},
    "expense_month": {"avg_amount": 6, "total_amount": 2},
    "expense_qoq": {"change": 2, "change_percent": 6, "total_amount": 2},
    "expense_share": {"share_percent": 6, "total_amount": 2},
    "expense_summary": {"avg_amount": 6, "total_amount": 2},
    "financial_report": {"expenses": 2, "net_income": 2, "revenue": 2},
    "histogram_quantiles": {"p50_latency_s": 6, "p95_latency_s": 6},
    "latency_quantiles": {"p50_latency_s": 6, "p95_latency_s": 6},
    "mean_latency": {"mean_latency_s": 6},
    "model_metrics": {"avg_time": 6, "last_time": 6, "throughput": 6, "total_time": 6},
    "performance_trend": {"avg_rating": 6, "change": 6},
    "request_rate": {"rate_per_s": 6},
    "revenue_projection": {"last_revenue": 2, "mean_growth": 6, "projected_revenue": 2},
    "revenue_yoy": {"revenue": 2, "share_percent": 6, "yoy_percent": 6},
    "stream_sessions": {"value_sum": 6},
    "user_sessions": {"value_sum": 6},
}


def _rounded(fn, places: dict[str, int]):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        return fn(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in places.items()})
    return run


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = _rounded(fn, DECIMALS[name]) if DECIMALS.get(name) else fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- SQL fragments used by the DuckDB oracles (same semantics as quarry.functions) ---

def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def lower_strip_sql(x: str) -> str:
    return f"lower({strip_sql(x)})"


def titlecase_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({strip_sql(x)}), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def clip_sql(x: str, lo, hi) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


BINDING_MODULES = ["bind_hr", "bind_sources", "bind_finance", "bind_columns", "bind_documents", "bind_routing", "bind_quality", "bind_metrics", "bind_streams", "bind_event_time", "bind_jobs"]


def load_all() -> None:
    """Import every binding module so its ``@query`` registrations run."""
    import importlib

    for m in BINDING_MODULES:
        importlib.import_module(f"quarry.plans.{m}")

"""Routing bindings: H11-H14, C5, D7, D8 over the question tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import routing as rt
from quarry.plans import fixtures as fx
from quarry.plans.catalog import query


def _contains_any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _case_sql(col, rules, default):
    return "CASE " + " ".join(f"WHEN {_contains_any_sql(col, ws)} THEN '{lab}'" for lab, ws in rules) + \
        f" ELSE '{default}' END"


UQ = fx.cte("user_queries")


@query("route_queries", UQ + f"""SELECT query_id, {_case_sql('lower(query)', rt.ORCHESTRATOR_RULES, 'general')}
  AS route FROM user_queries""")
def q_route(spark, sf):
    return rt.route(fx.table(spark, sf, "user_queries"), "query").select("query_id", "route")


@query("route_queries_agent", UQ + f"""SELECT query_id,
  {_case_sql('lower(query)', rt.AGENT_RULES, 'general')} AS route,
  {_case_sql('lower(query)', rt.SHORT_RULES, rt.SHORT_DEFAULT)} AS route_short FROM user_queries""")
def q_route_agent(spark, sf):
    q = fx.table(spark, sf, "user_queries")
    q = rt.route(q, "query", rt.AGENT_RULES, "general", "route")
    q = rt.route(q, "query", rt.SHORT_RULES, rt.SHORT_DEFAULT, "route_short")
    return q.select("query_id", "route", "route_short")


def _intent_sql():
    parts = []
    for domain, rules in rt.INTENT_RULES.items():
        parts.append(f"WHEN route = '{domain}' THEN {_case_sql('lower(query)', rules, rt.INTENT_DEFAULTS[domain])}")
    return "CASE " + " ".join(parts) + " ELSE 'general' END"


@query("query_intent", UQ + f"""SELECT query_id, route, {_intent_sql()} AS intent FROM (
  SELECT query_id, query, {_case_sql('lower(query)', rt.AGENT_RULES, 'general')} AS route FROM user_queries)""")
def q_intent(spark, sf):
    q = rt.route(fx.table(spark, sf, "user_queries"), "query", rt.AGENT_RULES, "general", "route")
    return rt.intent(q, "query").select("query_id", "route", "intent")


@query("answer_confidence", f"""SELECT conv_id, turn, round(CAST(greatest(0.0, least(1.0,
  0.5 + CASE WHEN length(text) > 100 THEN 0.2 ELSE 0.0 END
      + CASE WHEN {_contains_any_sql('lower(text)', rt.REPORT_WORDS)} THEN 0.15 ELSE 0.0 END
      + CASE WHEN {_contains_any_sql('lower(text)', rt.ERROR_WORDS)} THEN -0.3 ELSE 0.0 END)) AS DOUBLE), 6) AS confidence
FROM conversations WHERE role = 'assistant'""")
def q_confidence(spark, sf):
    conv = fx.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return conv.select("conv_id", "turn", F.round(rt.confidence(F.col("text")), 6).alias("confidence"))


@query("query_admission", UQ + """SELECT query_id,
  CASE WHEN query IS NULL OR regexp_replace(query, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty'
       WHEN length(query) > 1000 THEN 'too_long' END AS reason,
  (CASE WHEN query IS NULL OR regexp_replace(query, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty'
        WHEN length(query) > 1000 THEN 'too_long' END) IS NULL AS admitted,
  CASE WHEN NOT (query IS NULL OR regexp_replace(query, '^\\s+|\\s+$', '', 'g') = '')
        AND length(query) <= 1000 THEN regexp_replace(query, '^\\s+|\\s+$', '', 'g') END AS clean_query
FROM user_queries""")
def q_admission(spark, sf):
    return rt.admission(fx.table(spark, sf, "user_queries"), "query").select(
        "query_id", "reason", "admitted", "clean_query")


QL = fx.cte("query_log")


@query("agent_metrics", QL + """SELECT agent, count(*) AS total_queries,
  round(avg(processing_time), 6) AS avg_processing_time, round(avg(confidence), 6) AS avg_confidence
FROM query_log GROUP BY agent""")
def q_agent_metrics(spark, sf):
    return rt.agent_metrics(fx.table(spark, sf, "query_log"))


@query("model_metrics", QL + """SELECT model, count(*) AS total_inferences,
  round(sum(processing_time), 6) AS total_time, round(avg(processing_time), 6) AS avg_time,
  round(arg_max(processing_time, (ts, query_id)), 6) AS last_time,
  round(CASE WHEN avg(processing_time) > 0 THEN 1 / avg(processing_time) ELSE 0.0 END, 6) AS throughput
FROM query_log GROUP BY model""")
def q_model_metrics(spark, sf):
    return rt.model_metrics(fx.table(spark, sf, "query_log"))

"""All registered queries, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.plans import analysis_queries, composed_queries, incident_queries, log_queries, search_queries, stream_queries

_PARTS = (log_queries, analysis_queries, incident_queries, composed_queries, stream_queries, search_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}

#: Former names of queries that once saw a part of their tables; the plain names now see all of it.
for _name in [*log_queries.GRAMMARS, "health_state", "fleet_summary", "report_enrichment", "service_dependencies", "causal_chain"]:
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries.parse_cascade(spark, sf_dir)

"""The test tables as domain tables, in DataFrame form and, with the same arithmetic, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id") % 10
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("sess-"), F.col("event_id") % 20).alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("svc-"), n).alias("service_name"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "CRITICAL").when(kind == "click", "INFO").otherwise("DEBUG").alias("severity"),
        F.concat(F.lit("request "), 100000 + F.col("event_id"), F.lit(" code "), _k()).alias("message"),
        F.concat(F.lit("req-"), F.col("event_id") % 1000).alias("request_id"),
        F.when(n % 2 == 0, "prod").otherwise("staging").alias("environment"),
        F.concat(F.lit("v"), F.floor((F.dayofmonth("ts") - 1) / 7)).alias("deployment_version"),
        F.when(F.col("value") < 40, 200).when(F.col("value") < 80, 404).otherwise(503).alias("http_status"),
        F.col("value").alias("duration_ms"),
        F.col("props").alias("extra_fields"),
        (F.col("event_id") % 11 == 0).alias("is_malformed"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("pii_count"),
        F.element_at(F.array(*map(F.lit, ["json", "apache_combined", "apache_common", "syslog", "custom"])), (F.col("event_id") % 5 + 1).cast("int")).alias("log_format"),
    )


LOGS = """logs AS (SELECT event_id AS id, 'sess-' || (event_id % 20) AS session_id, ts AS "timestamp", 'svc-' || (user_id % 10) AS service_name,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'CRITICAL' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS severity,
  'request ' || (100000 + event_id) || ' code ' || json_extract_string(props, '$.k') AS message, 'req-' || (event_id % 1000) AS request_id,
  CASE WHEN user_id % 10 % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment, 'v' || ((day(ts) - 1) // 7) AS deployment_version,
  CASE WHEN value < 40 THEN 200 WHEN value < 80 THEN 404 ELSE 503 END AS http_status, value AS duration_ms, props AS extra_fields,
  event_id % 11 = 0 AS is_malformed, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS pii_count,
  (['json', 'apache_combined', 'apache_common', 'syslog', 'custom'])[event_id % 5 + 1] AS log_format FROM events)"""


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = logs(spark, sf_dir).select("service_name").distinct()
    n = F.regexp_extract("service_name", r"\d+", 0).cast("int")
    return names.select(
        F.col("service_name").alias("service_id"),
        F.concat(F.lit("Service "), n).alias("name"),
        F.when(n % 2 == 0, "prod").otherwise("staging").alias("environment"),
        (n != 9).alias("is_active"),
    )


SERVICES = """services AS (SELECT DISTINCT service_name AS service_id, 'Service ' || substr(service_name, 5) AS name,
  CASE WHEN substr(service_name, 5)::INT % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment, substr(service_name, 5)::INT <> 9 AS is_active FROM logs)"""


def indicator_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("svc-"), "label").alias("service_id"),
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("alert-"), "vec_id")).alias("alert_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("pattern-"), F.col("vec_id") % 4).alias("label"),
    )


VECTORS = """vectors AS (SELECT vec_id AS id, 'svc-' || label AS service_id, CASE WHEN vec_id % 3 = 0 THEN 'alert-' || vec_id END AS alert_id,
  embedding::DOUBLE[] AS embedding, 'pattern-' || (vec_id % 4) AS label FROM embeddings)"""


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each service and week: deployed when the week's first record came."""
    n = F.regexp_extract("service_name", r"\d+", 0).cast("int")
    week = F.regexp_extract("deployment_version", r"\d+", 0).cast("int")
    return (
        logs(spark, sf_dir).groupBy("service_name", "environment", "deployment_version").agg(F.min("timestamp").alias("deployed_at"))
        .select(
            F.concat_ws("/", "service_name", "deployment_version").alias("id"), "service_name", "environment",
            F.col("deployment_version").alias("version"), F.concat(F.lit("dev-"), (n + week) % 3).alias("deployed_by"), "deployed_at",
            F.create_map(
                F.lit("replicas"), (2 + (n + week) % 3).cast("string"), F.lit("region"), F.lit("eu"),
                F.when(week >= 2, F.lit("cache")).otherwise(F.lit("buffer")), week.cast("string"),
            ).alias("config_snapshot"),
        )
    )


DEPLOYMENTS = """deployments AS (SELECT service_name || '/' || deployment_version AS id, service_name, environment, deployment_version AS version,
  'dev-' || ((substr(service_name, 5)::INT + substr(deployment_version, 2)::INT) % 3) AS deployed_by, min("timestamp") AS deployed_at,
  substr(service_name, 5)::INT AS n, substr(deployment_version, 2)::INT AS week
  FROM logs GROUP BY service_name, environment, deployment_version),
config AS (SELECT id, 'replicas' AS k, (2 + (n + week) % 3)::VARCHAR AS v FROM deployments UNION ALL SELECT id, 'region', 'eu' FROM deployments
  UNION ALL SELECT id, CASE WHEN week >= 2 THEN 'cache' ELSE 'buffer' END, week::VARCHAR FROM deployments)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.when(o == "F", "true_positive").when(o == "O", "false_positive").when(F.col("o_orderkey") % 2 == 0, "false_negative").otherwise("true_negative").alias("verdict"),
        F.array(F.col("o_orderpriority")).alias("fired_indicators"),
        F.col("o_orderdate").alias("created_at"),
    )


OUTCOMES = """outcomes AS (SELECT o_orderkey AS incident_id, CASE WHEN o_orderstatus = 'F' THEN 'true_positive' WHEN o_orderstatus = 'O' THEN 'false_positive'
  WHEN o_orderkey % 2 = 0 THEN 'false_negative' ELSE 'true_negative' END AS verdict, o_orderpriority AS indicator, o_orderdate AS created_at FROM orders)"""

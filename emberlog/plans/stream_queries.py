"""Streams over the events table, drained for a comparison with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.plans import domain as D
from emberlog.plans.analysis_queries import BASE, VSCORE, WINDOWS
from emberlog.plans.log_queries import NORMAL
from emberlog.sources.shared import fresh_path
from emberlog.streaming import jobs

QUERIES, SQL = {}, {}


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of log records: the file source takes the schema and path, the adapter is the batch one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    class Reader:
        class read:  # noqa: N801
            @staticmethod
            def parquet(path: str) -> DataFrame:
                return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if path.endswith("/") else f"{path}*")

    return D.logs(Reader, sf_dir)


def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed by the end of the data."""
    out = jobs.drained(spark, jobs.velocity(_stream(spark, sf_dir)), f"velocity_{uuid.uuid4().hex}")
    return out.select("service_name", "severity", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "error_count")


def stream_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences and scores of the windows that the watermark has closed: one stream stores closed windows, a second one follows that table."""
    closed = jobs.drained(spark, jobs.velocity(_stream(spark, sf_dir)), f"velocity_{uuid.uuid4().hex}")
    out = jobs.drained(spark, jobs.with_derivatives(jobs.following(closed)), f"derivatives_{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that have been silent for two minutes at the end."""
    out = jobs.drained(spark, jobs.silence(_stream(spark, sf_dir), 2), f"silence_{uuid.uuid4().hex}")
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as alerts to two sinks: the table, and the messages for subscribers, read back as columns."""
    path = fresh_path(spark, "alerts")
    own = _stream(spark, sf_dir).where("severity = 'ERROR'").select("id", "service_name", "message")
    jobs.fan_out(own, path, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    alerts = spark.read.option("basePath", f"{path}/alerts").parquet(f"{path}/alerts").select("id", "service_name")
    messages = spark.read.text(f"{path}/messages").select(F.from_json("value", "id long, message string").alias("m")).select("m.*")
    return alerts.join(messages, "id")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.drained(spark, jobs.fingerprint_counts(_stream(spark, sf_dir)), f"dedup_{uuid.uuid4().hex}", "complete")
    return out.select("service_name", "fingerprint", "occurrence_count")


def stream_semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a small vector of its code."""
    k = F.get_json_object("extra_fields", "$.k").cast("double")
    own = _stream(spark, sf_dir).where("severity = 'ERROR'").select("service_name", "id", "timestamp", "message", F.array(F.cos(k), F.sin(k)).alias("embedding"))
    return jobs.drained(spark, jobs.semantic_dedup(own), f"semantic_{uuid.uuid4().hex}")


QUERIES |= {"stream_derivatives": stream_derivatives, "stream_silence": stream_silence, "stream_fan_out": stream_fan_out, "stream_velocity": stream_velocity, "stream_dedup": stream_dedup, "stream_semantic_dedup": stream_semantic_dedup}
SQL |= {
    "stream_velocity": f"""{BASE}, c AS (SELECT service_name, severity, time_bucket(INTERVAL 1 MINUTE, "timestamp") AS window_start, count(*) AS error_count FROM errs GROUP BY ALL)
SELECT * FROM c WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max("timestamp") FROM errs) - INTERVAL 5 MINUTES""",
    "stream_derivatives": f"""{BASE}, {WINDOWS} SELECT service_name, severity, window_start, error_count, first_derivative, second_derivative, {VSCORE} AS velocity_score FROM w
WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max("timestamp") FROM errs) - INTERVAL 5 MINUTES""",
    "stream_silence": f"""WITH {D.LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY "timestamp" DESC) AS n, count(*) OVER (PARTITION BY service_name) AS records, max("timestamp") OVER (PARTITION BY service_name) AS last_seen FROM logs)
SELECT service_name, last_seen, records FROM r WHERE n = 10 AND "timestamp" >= last_seen + INTERVAL 2 MINUTES - INTERVAL 7 DAYS AND last_seen + INTERVAL 2 MINUTES < (SELECT max("timestamp") FROM logs) - INTERVAL 1 MINUTE""",
    "stream_fan_out": f"WITH {D.LOGS} SELECT id, service_name, message FROM logs WHERE severity = 'ERROR'",
    # One row for each record, in order: the groups so far stand in the order of their last use, so the first of equally similar ones is that used longest ago.
    "stream_semantic_dedup": f"""WITH RECURSIVE {D.LOGS}, o AS (SELECT service_name, id, sha256({NORMAL}) AS print, cos(json_extract_string(extra_fields, '$.k')::DOUBLE) AS x, sin(json_extract_string(extra_fields, '$.k')::DOUBLE) AS y,
  row_number() OVER (PARTITION BY service_name ORDER BY "timestamp", id) AS n FROM logs WHERE severity = 'ERROR'),
r AS (SELECT DISTINCT service_name, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS group_fingerprint, false AS is_new, []::STRUCT(name VARCHAR, x DOUBLE, y DOUBLE)[] AS groups FROM o
UNION ALL SELECT service_name, n, id, coalesce(g.name, print), g.name IS NULL, list_append(list_filter(groups, lambda h: h.name <> coalesce(g.name, print)), {{
  'name': coalesce(g.name, print), 'x': CASE WHEN g.name IS NULL THEN round(x, 6) ELSE round(0.9::DOUBLE * g.x + 0.1::DOUBLE * x, 6) END, 'y': CASE WHEN g.name IS NULL THEN round(y, 6) ELSE round(0.9::DOUBLE * g.y + 0.1::DOUBLE * y, 6) END}})
FROM (SELECT *, CASE WHEN len(own) > 0 THEN own[1] WHEN list_max(near) >= {jobs.SIMILARITY} THEN late[list_position(near, list_max(near))] END AS g
FROM (SELECT *, list_transform(late, lambda h: (h.x * x + h.y * y) / (sqrt(h.x * h.x + h.y * h.y) * sqrt(x * x + y * y))) AS near
FROM (SELECT o.*, groups, list_filter(groups, lambda h: h.name = print) AS own, groups[-{jobs.RECENT_GROUPS}:] AS late FROM r JOIN o ON o.service_name = r.service_name AND o.n = r.n + 1))))
SELECT service_name, id, group_fingerprint, is_new FROM r WHERE n > 0""",
    "stream_dedup": f"{BASE} SELECT service_name, sha256({NORMAL}) AS fingerprint, count(*) AS occurrence_count FROM errs GROUP BY ALL",
}

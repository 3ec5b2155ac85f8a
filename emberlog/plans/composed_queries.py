"""Queries of whole jobs, and of readers and sinks: written, read back and compared."""

from __future__ import annotations

import gzip
import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import composed as C
from emberlog.operators import errors as E
from emberlog.operators import incidents as I  # noqa: E741
from emberlog.plans import analysis_queries as A
from emberlog.plans import domain as D
from emberlog.plans import incident_queries as Q
from emberlog.plans import log_queries as G
from emberlog.sources import commits, readers, sinks
from emberlog.sources.shared import fresh_path, stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {G.RAW}, {G._PARSED}, c AS (SELECT session_id, log_format, count(*) AS n, min(event_id) AS f FROM x GROUP BY ALL), v AS (SELECT session_id, arg_max(log_format, (n, -f)) AS dominant_format FROM c GROUP BY session_id)
SELECT x.session_id, count(*) AS total_lines, count(*) FILTER (WHERE NOT is_malformed) AS inserted, count(*) FILTER (WHERE is_malformed) AS failed, 0::BIGINT AS pii_total, any_value(dominant_format) AS dominant_format,
CASE WHEN count(*) FILTER (WHERE NOT is_malformed) > 0 THEN 'completed' ELSE 'failed' END AS status FROM x JOIN v ON x.session_id = v.session_id GROUP BY x.session_id""")
def ingest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = G.raw_lines(spark, sf_dir).withColumnRenamed("event_id", "id")
    return C.process_sessions(lines, D.as_of(), fresh_path(spark, "ingested"), "all")


@query(SQL["ingest_sessions"])
def ingest_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines in two batches, each delivered twice, with an attempt in between that dies before its commit: the tables are those of one delivery."""
    lines = G.raw_lines(spark, sf_dir).withColumnRenamed("event_id", "id")
    path = fresh_path(spark, "ingested")
    for k in (0, 0, 1, 1):
        C.process_sessions(lines.where(F.col("id") % 2 == k), D.as_of(), path, f"part {k}")
        sinks.write_records(C.records_of(lines.where(F.col("id") % 100 == k), D.as_of()), commits.folder(path, "records", commits.new_attempt()))
    return C.ingested_sessions(spark, path)


@query(f"""SELECT coalesce(d.service_name, c.service_id, h.service_id) AS service_id, d.processed AS errors, d.new_groups, d.merged, c.processed, c.clusters, c.noise, c.silhouette, h.health_score
FROM ({A.SQL['dedup_pass']}) d FULL JOIN ({A.SQL['cluster_pass']}) c ON d.service_name = c.service_id FULL JOIN ({Q.SQL['health_state']}) h ON h.service_id = coalesce(d.service_name, c.service_id)""")
def analysis_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.logs(spark, sf_dir)
    known = E.dedup_groups(own.where(F.col("timestamp") < D.as_of() - F.expr("INTERVAL 7 DAYS")))
    out = C.analyse(own, known, D.indicator_vectors(spark, sf_dir), Q._health(spark, sf_dir), D.as_of(), 7 * 24 * 60, A.EPS)
    return out.withColumn("silhouette", F.round("silhouette", 3))


@query(f"""WITH {A.L}, {Q.ALL_CAUSES}, {Q.ALL_DEPS.format(lead=1800, ratio=0.45)}, ch AS (WITH {Q.CHAIN})
SELECT string_agg(service, ',' ORDER BY service) AS affected_services, 'stub ' || substr(md5(string_agg('Step ' || step || ': [' || service || '] ' || description, chr(10) ORDER BY step)), 1, 8) AS root_cause_summary, 0.5::DOUBLE AS confidence FROM ch""")
def root_cause_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.root_cause_report(I.causes(D.logs(spark, sf_dir)), 1800, 0.45)


@query(f"{A.BASE} SELECT service_name, sha256({G.NORMAL}) AS fingerprint, id FROM errs")
def dedup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dedup_members(D.logs(spark, sf_dir))


# --- readers and sinks: a round trip through files


def _recognised(spark: SparkSession, path: str) -> bool:
    """Whether every gzip file under path has the signature."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.where(~(readers.magic() == "gz")).limit(1).count() == 0


@query("SELECT event_id || ' ' || event_type || ' ' || user_id AS value FROM events")
def src_gzip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as gzip files and read back; each file's signature is one of gzip."""
    path = fresh_path(spark, "gzip")
    line = F.concat_ws(" ", "event_id", "event_type", "user_id").alias("value")
    D.read(spark, sf_dir, "events").select(line).write.option("compression", "gzip").text(path)
    return readers.text_lines(spark, path).select("value").where(F.lit(_recognised(spark, path)))


def _archive(rows: pa.Table) -> pa.Table:
    """A file for each group of lines: a zip archive of three members, gzip, or plain text, also with a name of gzip."""
    n = rows.column("part")[0].as_py()
    lines = [x.encode() for x in rows.sort_by("event_id").column("line").to_pylist()]
    text = b"\n".join(lines)
    if n % 4 == 0:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if n % 8 else zipfile.ZIP_STORED) as z:
            for k in range(3):
                z.writestr(f"{k}/log.txt", b"\n".join(lines[k::3]))
        content = out.getvalue()
    else:
        content = gzip.compress(text) if n % 4 == 1 else text
    return pa.table({"path": [f"part-{n}.{'txt' if n % 4 == 3 else 'gz'}"], "content": pa.array([content], pa.binary())})


@query("""SELECT 'part-' || (event_id % 61) || CASE WHEN event_id % 61 % 4 = 3 THEN '.txt' ELSE '.gz' END AS session_id, count(*) AS total_lines, 0::BIGINT AS inserted, count(*) AS failed, 0::BIGINT AS pii_total,
'custom' AS dominant_format, 'failed' AS status, 'svc-' || (event_id % 61 % 5) AS service_name, CASE WHEN event_id % 61 % 2 = 0 THEN 'prod' END AS environment FROM events WHERE event_id % 61 <> 7 GROUP BY ALL""")
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives as uploads with tags, one of them too large: statistics of each, and the tags that their records have."""
    path, part = fresh_path(spark, "uploads"), F.regexp_extract("path", r"(\d+)", 1).cast("int")
    # uploads lie in files: their tags are read without their content
    files = stored(_archives(spark, sf_dir), "archives").withColumn("length", F.when(part == 7, 10**9).otherwise(F.octet_length("content")))
    files = files.withColumns({"service_name": F.concat(F.lit("svc-"), part % 5), "environment": F.when(part % 2 == 0, "prod")})
    stats, _ = C.upload(files, D.as_of(), path, "all")
    schema = C.records_of(G.raw_lines(spark, sf_dir).withColumnRenamed("event_id", "id"), D.as_of()).schema
    tags = commits.read(spark, path, "records", schema).select("session_id", "service_name", "environment").distinct()
    return stats.join(tags, "session_id")


@query("SELECT 'part-' || (event_id % 61) || CASE WHEN event_id % 61 % 4 = 3 THEN '.txt' ELSE '.gz' END AS file, event_id || ' ' || event_type || ' ' || user_id AS value FROM events")
def src_archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as lines of archives, gzip files and text with a name of gzip, unpacked again."""
    return readers.lines_of(_archives(spark, sf_dir)).select("file", "value")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", "event_id", "event_type", "user_id").alias("line")
    own = D.read(spark, sf_dir, "events").select((F.col("event_id") % 61).alias("part"), "event_id", line)
    return own.groupBy("part").applyInArrow(_archive, "path string, content binary")


@query("""SELECT '{"p_partkey":"' || p_partkey || '","p_size":"' || p_size || '","p_type":"' || p_type || '"}' AS value FROM part""")
def src_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV with a header, read back as JSON objects of texts."""
    path = fresh_path(spark, "csv")
    D.read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type").write.option("header", True).csv(path)
    return readers.csv_lines(spark, path)


@query(f"""WITH {D.LOGS} SELECT id, service_name, severity, "timestamp", CAST("timestamp" AS DATE) AS event_date FROM logs""")
def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records appended by day and read back."""
    path = fresh_path(spark, "records")
    sinks.write_records(D.logs(spark, sf_dir).select("id", "service_name", "severity", "timestamp"), path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey AS incident_id, o_orderstatus AS verdict FROM orders UNION ALL SELECT o_orderkey, 'reviewed' FROM orders")
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes appended twice, as audit rows, snapshots, embeddings and outcomes are: nothing written before is lost."""
    path = fresh_path(spark, "outcomes")
    own = D.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_orderstatus").alias("verdict"))
    sinks.append(own, path)
    sinks.append(own.withColumn("verdict", F.lit("reviewed")), path)
    return spark.read.parquet(path)

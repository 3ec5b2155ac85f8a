"""Whole jobs: the operators of ingestion, analysis and root causes one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.providers import with_completion
from emberlog.functions.redaction import redact_records
from emberlog.operators import errors as E
from emberlog.operators import incidents as I  # noqa: E741
from emberlog.operators import parsing as P
from emberlog.sources import commits, sinks
from emberlog.sources.readers import accepted, lines_of


def records_of(lines: DataFrame, as_of: Column) -> DataFrame:
    """What is stored of lines (id, session_id, value): parsed by the first grammar that fits, without personal data, severities and formats as stored.

    Columns tag_service and tag_environment, if lines have them, stand in where a line names no service or environment.
    """
    parsed = P.parse_lines(lines, as_of)
    for tag, name in TAGS.items():
        if tag in lines.columns:
            parsed = parsed.withColumn(name, F.coalesce(name, tag)).drop(tag)
    clean = sinks.stored_rows(redact_records(parsed))
    return clean.withColumns({"extra_fields": F.to_json("extra_fields"), "severity": P.map_severity(F.col("severity")), "log_format": P.map_format(F.col("log_format"))})


#: Tags of an upload, and the fields that they stand in for.
TAGS = {"tag_service": "service_name", "tag_environment": "environment"}
INGESTED = ["records", "sessions", "audit"]
_PARTS = "session_id string, log_format string, lines long, first long, inserted long, failed long, pii_total long"


def session_parts(records: DataFrame) -> DataFrame:
    """What a batch adds to its sessions' statistics: sums by session and format, which add up across batches."""
    return records.groupBy("session_id", "log_format").agg(
        F.count("*").alias("lines"), F.min("id").alias("first"), F.count_if(~F.col("is_malformed")).alias("inserted"), F.count_if("is_malformed").alias("failed"), F.sum("pii_count").alias("pii_total")
    )


def session_totals(parts: DataFrame) -> DataFrame:
    """Statistics, most frequent format (of equally frequent ones that of the earliest line) and status of sessions, from the parts of any number of batches."""
    sums = {c: F.sum(c).alias(c) for c in ("lines", "inserted", "failed", "pii_total")}
    by_format = parts.groupBy("session_id", "log_format").agg(*sums.values(), F.min("first").alias("first"))
    whole = by_format.groupBy("session_id").agg(
        F.sum("lines").alias("total_lines"), F.sum("inserted").alias("inserted"), F.sum("failed").alias("failed"), F.sum("pii_total").alias("pii_total"),
        F.max_by("log_format", F.struct("lines", -F.col("first"))).alias("dominant_format"),
    )
    return whole.withColumn("status", F.when(F.col("inserted") > 0, "completed").otherwise("failed"))


def process_sessions(lines: DataFrame, as_of: Column, path: str, batch: str) -> DataFrame:
    """Ingests a batch of lines (id, session_id, value) of any number of sessions, once however often it is delivered; the statistics of its sessions within it.

    Records, parts of statistics and an audit row for each session are written
    to an attempt's own folders under path and committed together by one
    manifest. A batch that failed anywhere before is done again from the
    start, and one that was committed is only read; statistics come from the batch's own files.
    """
    spark = lines.sparkSession
    done = commits.find(spark, path, batch)
    if done is None:
        attempt = commits.new_attempt()
        at = {t: commits.folder(path, t, attempt) for t in INGESTED}
        # a line costs far more work than bytes, so lines are dealt out evenly whatever files, archives or row groups they came from
        even = lines.repartition(4 * spark.sparkContext.defaultParallelism, "session_id", "id")
        records = records_of(even, as_of)
        sinks.write_records(records, at["records"])
        own = spark.read.schema(records.schema).parquet(at["records"])
        session_parts(own).write.parquet(at["sessions"])
        totals = session_totals(spark.read.schema(_PARTS).parquet(at["sessions"]))
        details = sinks.payload("total_lines", "failed", "pii_total")
        sinks.append(totals.select(F.lit("session_processed").alias("action"), as_of.alias("at"), "session_id", details.alias("details")), at["audit"])
        done = commits.publish(spark, path, batch, attempt, INGESTED)
    return session_totals(commits.read(spark, path, "sessions", spark.createDataFrame([], _PARTS).schema, [done]))


def upload(files: DataFrame, as_of: Column, path: str, batch: str) -> tuple[DataFrame, DataFrame]:
    """Ingests uploaded files (path, length, content, and service_name and environment as tags, both may be null), one session each with its path as id.

    Returns the sessions' statistics and the files that were refused, with the reason. A file of no line has no session.
    """
    judged = accepted(files)
    own = judged.where("valid")
    tags = own.select(F.col("path").alias("file"), F.col("service_name").alias("tag_service"), F.col("environment").alias("tag_environment"))
    lines = lines_of(own).join(tags, "file")
    lines = lines.select(F.col("pos").alias("id"), F.col("file").alias("session_id"), "value", *TAGS)
    return process_sessions(lines, as_of, path, batch), judged.where("not valid").select("path", "reason")


def ingested_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of all sessions over all committed batches, without a look at their records."""
    return session_totals(commits.read(spark, path, "sessions", spark.createDataFrame([], _PARTS).schema))


def analyse(logs: DataFrame, known: DataFrame, vectors: DataFrame, health: DataFrame, as_of: Column, minutes: int = 60, eps: float = E.EPS) -> DataFrame:
    """One analysis round of all services: the dedup pass, the clustering pass and the health state, a row for each service that any of them has."""
    dedup = E.dedup_pass(logs, known, as_of, minutes).withColumnRenamed("service_name", "service_id").withColumnRenamed("processed", "errors")
    labels = E.dbscan(vectors, eps=eps)
    clusters = E.cluster_summary(vectors.drop("label").join(labels.select("id", "label"), "id"))
    passed = E.cluster_pass_summary(labels, clusters)
    return dedup.join(passed, "service_id", "full_outer").join(health.select("service_id", "health_score"), "service_id", "full_outer")


def narrative_confidence(summary: Column) -> Column:
    """The confidence that a text names, between 0 and 1; 0.5 if it names none."""
    named = F.regexp_extract(summary, r"(?i)confidence[:\s]+([0-9.]+)", 1).try_cast("double")
    return F.when(named.isNull(), 0.5).otherwise(F.least(F.greatest(named, F.lit(0.0)), F.lit(1.0)))


def root_cause_report(events: DataFrame, lead: int = I.LEAD_SECONDS, ratio: float = I.LEAD_RATIO, provider: str = "stub") -> DataFrame:
    """One row: affected_services, root_cause_summary and confidence of events (as timeline or causes give them).

    The provider sees the causal chain; where it fails the first step stands in, with a confidence of 0.3.
    """
    chain = I.causal_chain(events, I.dependencies(events, lead, ratio))
    step = F.struct("step", F.format_string("Step %d: [%s] %s", "step", "service", "description").alias("text"), "service", "description")
    whole = chain.agg(F.array_sort(F.collect_list(step)).alias("steps"))  # a step for each service
    prompt = F.array_join(F.transform("steps", lambda x: x["text"]), "\n")
    own = with_completion(whole.withColumn("prompt", prompt), F.col("prompt"), F.lit(None).cast("string"), provider)
    first = F.coalesce(F.get("steps", F.lit(0))["description"], F.lit("no data"))
    alone = F.concat(F.lit("Structural correlation only. First causal step: "), first)
    return own.select(
        F.array_join(F.array_sort(F.transform("steps", lambda x: x["service"])), ",").alias("affected_services"),
        F.coalesce("completion", alone).alias("root_cause_summary"),
        F.when(F.col("completion").isNull(), 0.3).otherwise(narrative_confidence(F.col("completion"))).alias("confidence"),
    )

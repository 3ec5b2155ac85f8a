"""Error counts by minute that are kept, so that no round scans records again.

Each batch of records adds its own counts, once (a commit by manifest). Counts
add up, so baselines, windows and scores come from sums of small rows of the
days that they look back to; records are read once, when they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberlog.operators import signals as S
from emberlog.operators.errors import errors
from emberlog.sources import commits

TABLE = "minutes"
_SCHEMA = "service_name string, severity string, minute timestamp_ntz, n long, day date"


def add(logs: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of records to the counts under path, once however often it is delivered. Records without a time have no minute and aren't counted."""
    spark = logs.sparkSession
    if commits.find(spark, path, batch) is not None:
        return
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz")
    counts = errors(logs).where("timestamp is not null").groupBy("service_name", "severity", minute.alias("minute")).agg(F.count("*").alias("n"))
    attempt = commits.new_attempt()
    counts.withColumn("day", F.to_date("minute")).write.partitionBy("day").parquet(commits.folder(path, TABLE, attempt))
    commits.publish(spark, path, batch, attempt, [TABLE])


def follow(logs: DataFrame, path: str, checkpoint: str, every: str = "60 seconds", name: str = "stream") -> DataStreamWriter:
    """Adds a stream's micro-batches, one each time the trigger fires; one that is tried again counts once."""

    def store(batch: DataFrame, number: int) -> None:
        add(batch, path, f"{name}/{number}")

    return logs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def minutes(spark: SparkSession, path: str, as_of: Column, days: int) -> DataFrame:
    """service_name, severity, minute, n: all counts of the days that days before as_of reach into; others' files aren't read."""
    kept = commits.read(spark, path, TABLE, spark.createDataFrame([], _SCHEMA).schema)
    recent = kept.where((F.col("day") >= F.to_date(as_of - F.expr(f"INTERVAL {days} DAYS"))) & (F.col("day") <= F.to_date(as_of)))
    return recent.groupBy("service_name", "severity", "minute").agg(F.sum("n").alias("n"))


def hourly_counts(spark: SparkSession, path: str, as_of: Column, days: int = 14) -> DataFrame:
    """signals.hourly_counts() from kept counts; as_of is a full minute."""
    start, end = as_of - F.expr(f"INTERVAL {days} DAYS"), as_of - F.expr("INTERVAL 1 HOUR")
    own = minutes(spark, path, as_of, days).where((F.col("minute") >= start) & (F.col("minute") < end))
    return own.groupBy("service_name", F.date_trunc("hour", "minute").cast("timestamp_ntz").alias("hour")).agg(F.sum("n").alias("n"))


def velocity_windows(spark: SparkSession, path: str, as_of: Column, days: int = 28) -> DataFrame:
    """signals.velocity_windows() of a minute each from kept counts of the days before as_of; a key's first windows in that time have no windows before."""
    by = W.partitionBy("service_name", "severity").orderBy("window_start")
    one, two = F.lag("error_count", 1).over(by), F.lag("error_count", 2).over(by)
    own = minutes(spark, path, as_of, days).select("service_name", "severity", F.col("minute").alias("window_start"), F.col("n").alias("error_count"))
    return own.select(
        "*", F.coalesce(F.col("error_count") - one, F.lit(0)).alias("first_derivative"), F.coalesce(F.col("error_count") - 2 * one + two, F.lit(0)).alias("second_derivative")
    )


def baselines(spark: SparkSession, path: str, as_of: Column, days: int = 14) -> DataFrame:
    return S.baseline(hourly_counts(spark, path, as_of, days), ["service_name"])


def baseline_scores(spark: SparkSession, path: str, as_of: Column, days: int = 28) -> DataFrame:
    return S.baseline_scores(velocity_windows(spark, path, as_of, days), as_of, days)

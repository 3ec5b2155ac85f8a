"""Where records, events and reports go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str) -> None:
    """Appends records by day, ordered by service and time within a file, so that scans skip by both.

    Rows are rebalanced by day: adaptive execution cuts a day (or the rows
    without a time) into as many tasks and files as its size asks for, and puts small days together.
    """
    dated = records.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", F.col("event_date"))
    dated.sortWithinPartitions("event_date", "service_name", "timestamp").write.mode("append").partitionBy("event_date").parquet(path)


def stored_rows(records: DataFrame) -> DataFrame:
    """What is stored of a record: the raw line only if no personal data was found in it."""
    return records.withColumn("raw_line", F.when(~F.col("pii_was_redacted"), F.col("raw_line")))


def append(rows: DataFrame, path: str) -> None:
    """Audit rows, embeddings, deployment snapshots and outcomes: append-only tables."""
    rows.write.mode("append").parquet(path)


def payload(*columns: str | Column) -> Column:
    """A message for subscribers."""
    return F.to_json(F.struct(*columns))

"""Batches of files that readers see all at once or not at all.

A batch writes each of its tables to folders of its own attempt. Then one small
manifest that names them is renamed into place, which an attempt of the same
batch can't do a second time. Readers follow manifests alone, so what a failed
or slower attempt left behind is never read, and a batch that is delivered
again finds its manifest and does nothing. The file system must rename
atomically and refuse to rename onto a file, as HDFS does.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(batch: str) -> str:
    return f"{hashlib.sha256(batch.encode()).hexdigest()}.json"


def new_attempt() -> str:
    return f"a{uuid.uuid4().hex}"


def folder(path: str, table: str, attempt: str) -> str:
    return f"{path}/{table}/attempt={attempt}"


def find(spark: SparkSession, path: str, batch: str) -> dict | None:
    """The manifest of a batch, if it was committed."""
    at, fs = _path(spark, f"{path}/{MANIFESTS}/{_name(batch)}")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, batch: str, attempt: str, tables: list[str]) -> dict:
    """Commits the folders of an attempt, in one rename. If another attempt of the batch was faster its manifest counts, and is returned."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    manifest = {"batch": batch, "attempt": attempt, "tables": tables}
    draft, fs = _path(spark, f"{path}/{MANIFESTS}/.{attempt}")
    final, _ = _path(spark, f"{path}/{MANIFESTS}/{_name(batch)}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception:  # the batch was committed meanwhile, or the store failed
        fs.delete(draft, False)
        if (faster := find(spark, path, batch)) is None:
            raise
        return faster
    return manifest


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All manifests, one small row for each batch."""
    at, fs = _path(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(at):
        return []
    return [json.loads(r[0]) for r in spark.read.option("pathGlobFilter", "*.json").text(f"{path}/{MANIFESTS}", wholetext=True).collect()]


def read(spark: SparkSession, path: str, table: str, schema: T.StructType, only: list[dict] | None = None) -> DataFrame:
    """A table of all committed batches, or of only those; partition columns of its folders are in schema."""
    named = [folder(path, table, m["attempt"]) for m in (manifests(spark, path) if only is None else only) if table in m["tables"]]
    if not named:
        return spark.createDataFrame([], schema)
    own = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return spark.read.schema(own).option("basePath", f"{path}/{table}").parquet(*named).drop("attempt")


def vacuum(spark: SparkSession, path: str, tables: list[str], before_ms: int) -> int:
    """Deletes folders of attempts that no manifest names and that weren't changed since before_ms (choose it earlier than any running batch began); how many there were."""
    kept, gone = {m["attempt"] for m in manifests(spark, path)}, 0
    for table in tables:
        at, fs = _path(spark, f"{path}/{table}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            name = status.getPath().getName()
            if name.startswith("attempt=") and name[8:] not in kept and status.getModificationTime() < before_ms:
                fs.delete(status.getPath(), True)
                gone += 1
    return gone

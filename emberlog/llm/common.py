"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the word rules: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, unlike lower()."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset in a local session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='emberlog-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop, if the session still runs."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the gateway may be gone at exit
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it is computed once, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collects garbage here and in the driver's JVM, so that Spark deletes the shuffle files of finished steps now rather than some day."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def joined_by(rows: DataFrame, facts: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """rows with the other columns of facts (one row for each key; key_rows says how many rows have it, and is left out), where one key may have any share of rows.

    Keys of more than one row in share are share at most, so their facts are
    broadcast and their rows stay where they are; the others meet by a shuffle.
    """
    least = F.lit((facts.agg(F.sum("key_rows")).first()[0] or 0) // share)
    hot = F.broadcast(facts.where(F.col("key_rows") > least).drop("key_rows"))
    cold = facts.where(F.col("key_rows") <= least).drop("key_rows")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))

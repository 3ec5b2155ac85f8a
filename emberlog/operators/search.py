"""English full-text search over stored records that opens only the files that can match.

A batch stores its records by slot of the day, and beside them, for
each day and word, which slots hold the word, as bits. A search looks its
stems up, intersects their slots, and reads the records of those slots alone:
the slots reach the scan as a dynamic partition filter. Batches are committed
as a whole (see commits), so a batch delivered again changes nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions import english as E
from emberlog.sources import commits
from emberlog.sources.shared import stored

TERMS = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("part", T.LongType()),
    T.StructField("slots", T.LongType()), T.StructField("day", T.StringType()),
])
PLACE = T.StructType([T.StructField("day", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("place", T.StringType())])
#: Slots of days are broadcast up to this number, some MB; beyond it they meet the records by a shuffle.
BROADCAST_SLOTS = 100_000


def place(day: str, slot: str) -> Column:
    return F.concat(F.col(day), F.lit("."), F.col(slot))


def placed(records: DataFrame, slots: int) -> DataFrame:
    """records with day ("none" without a timestamp), which of the day's slots they belong to, and the folder of that slot (one column, so that a filter by slot names no other day's)."""
    second = F.hour("timestamp") * 3600 + F.minute("timestamp") * 60 + F.second("timestamp")
    day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none"))
    slot = F.coalesce(F.floor(second * slots / 86_400), F.lit(0)).cast("int")
    return records.withColumn("day", day).withColumn("slot", slot).withColumn("place", place("day", "slot"))


def terms(records: DataFrame) -> DataFrame:
    """For each day and word of placed records (message): its stem, and in parts of 64 the slots that hold it, as bits.

    Words are added up before they leave a task, and stems are taken of what is
    left, one row for each day and word. Stop words are left out.
    """
    one = records.select("day", "slot", F.explode(F.array_distinct(E.words(F.col("message")))).alias("word"))
    own = one.where(~F.col("word").isin(E.ENGLISH_STOP_WORDS)).select("day", "word", F.expr("cast(slot div 64 as bigint)").alias("part"), F.expr("shiftleft(1L, slot % 64)").alias("bit"))
    kept = own.groupBy("day", "word", "part").agg(F.bit_or("bit").alias("slots"))
    return E.with_stem(kept, "word").select("word", "stem", "part", "slots", "day")


def index_batch(records: DataFrame, path: str, batch: str, slots: int = 24) -> dict:
    """Stores records (timestamp, message and any others, but not day, slot, place or _forms) and their terms, as one commit; its manifest.

    A day is cut into slots of equal length; choose as many as make a slot of
    a batch some files' worth (batches may differ: the folders that a search
    opens are those that hold its words). Rows are rebalanced by folder, so a slot that holds most records is many
    tasks and files. Terms are sorted by stem, so that a search skips row groups.
    """
    spark = records.sparkSession
    if (done := commits.find(spark, path, batch)) is not None:
        return done
    attempt = commits.new_attempt()
    at = commits.folder(path, "records", attempt)
    dated = placed(records, slots)
    dated.hint("rebalance", F.col("place")).sortWithinPartitions("place").write.partitionBy("place").parquet(at)
    own = spark.read.schema(dated.schema).parquet(at)
    terms(own).hint("rebalance", F.col("day")).sortWithinPartitions("day", "stem").write.partitionBy("day").parquet(commits.folder(path, "terms", attempt))
    return commits.publish(spark, path, batch, attempt, ["records", "terms"])


def query_stems(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems that a query asks for, without stop words."""
    one = spark.createDataFrame([(query,)], "query string").select(F.explode(E.words(F.col("query"))).alias("word")).distinct()
    return sorted({r["stem"] for r in E.with_stem(one.where(~F.col("word").isin(E.ENGLISH_STOP_WORDS)), "word").collect()})


def slots_with(index: DataFrame, stems: list[str]) -> DataFrame:
    """The places that hold all stems, with the words that each stem has on that day (_forms: one list for each stem)."""
    held = index.where(F.col("stem").isin(stems)).groupBy("day", "stem", "part").agg(F.bit_or("slots").alias("slots"), F.collect_set("word").alias("words"))
    both = held.groupBy("day", "part").agg(F.count("*").alias("n"), F.bit_and("slots").alias("slots")).where(F.col("n") == len(stems))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("slots"), b) == 1)
    slots = both.select("day", "part", F.explode(bits).alias("bit")).select("day", (F.col("part") * 64 + F.col("bit")).cast("int").alias("slot"))
    forms = held.groupBy("day", "stem").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")).groupBy("day").agg(F.collect_list("words").alias("_forms"))
    return slots.join(forms, "day").select(place("day", "slot").alias("place"), "_forms")


def search(spark: SparkSession, path: str, schema: T.StructType, query: str) -> DataFrame:
    """Committed records (of that schema) whose message has every word of the query in some English form; words between don't matter.

    A query without any word but stop words finds nothing. No row grows with
    the data: a day's list of forms holds the words of one stem, whose endings
    are a fixed set.
    """
    stored_as = T.StructType([*schema.fields, *PLACE.fields])
    records = commits.read(spark, path, "records", stored_as)
    stems = query_stems(spark, query)
    if not stems:
        return records.select(schema.names).limit(0)
    found = stored(slots_with(commits.read(spark, path, "terms", TERMS), stems), "slots")
    opened = found.where("place > ''")
    if found.count() <= BROADCAST_SLOTS:
        opened = F.broadcast(opened)
    has_all = reduce(and_, [F.arrays_overlap(F.get("_forms", F.lit(k)), E.words(F.col("message"))) for k in range(len(stems))])
    return records.join(opened, "place").where(has_all).select(schema.names)

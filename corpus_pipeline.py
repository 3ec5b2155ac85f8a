"""From raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of documents, whatever their
names; rows are packed into a struct while it works, so no name clashes. Null
and empty texts fail the quality rules; the stages after them treat them, and
repeated rows, ties and null ids, as their operators say. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, line_dedup, packing, quality, simhash
from emberlog.llm.common import fresh_path, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Rows are judged one by one: a null or empty text has no words and goes; repeated rows stay together."""
    return quality.judged(docs).where("kept").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that a document of a larger id repeats; n_chars follows. A null text stays null; equal ids count as one document."""
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    columns = [F.when(F.col("n_dropped") > 0, changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns]
    return line_dedup.deduped(docs).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8. The smallest id stays, a null one before others; of equal rows one."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Rows are told apart by id and text, so that rows of one id don't share a fate; equal rows do, and a null text has no words."""
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.contamination(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), slack=0)
    hit = found.where("contaminated").select(F.col("doc_id").alias("hit")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), row.alias("own"))
    return own.join(hit, F.col("own") == F.col("hit"), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_rules", drop_poor),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]
#: Fingerprints, rolling hashes and packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

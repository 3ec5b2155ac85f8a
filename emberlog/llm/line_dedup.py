"""Line dedup: which lines of a corpus are repeated, as keep bitmaps.

Lines become (hash, document, position) rows. The hashes are range-partitioned
and sorted within partitions by document and position; a window streams over
them, and all lines of a key but those of its last document go. What comes
back is not text but, for each document, the 64-bit words of a bitmap of
dropped lines, only those that aren't zero. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import SPACES, ascii_lower, stored, table, tasks

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys with more lines than this don't go through one task's window: counts aggregated before the shuffle decide them.
HOT_LINES = 5_000
_DOC = ("doc_id", "text_hash")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that is long enough: two 64-bit hashes of its key (128 bits tell any number of lines apart), document, position."""
    key = line_key(F.col("line"))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select(*_DOC, "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *_DOC, "pos")
    )


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, text_hash, pos of the lines that go."""
    lines = stored(_lines(docs, min_chars), "lines")
    # Partial aggregation sums up a hot key before the shuffle.
    hot = (
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") > hot_lines)
    )
    hot = stored(hot, "hot-lines")
    key = ["h1", "h2"]
    calm = lines.join(hot.select(*key), key, "left_anti")
    # Equal hashes share a partition; ENSURE_REQUIREMENTS adds no second exchange for the windows.
    calm = calm.repartitionByRange(tasks(docs), *key).sortWithinPartitions(
        *key, F.desc_nulls_last("doc_id"), F.asc("pos")
    )
    stream = W.partitionBy(*key).orderBy(F.desc_nulls_last("doc_id"))
    cold = (
        calm.withColumn("nth", F.dense_rank().over(stream))
        .withColumn("holders", F.max("nth").over(stream.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .where((F.col("nth") > 1) & (F.col("holders") >= min_docs))
        .select(*_DOC, "pos")
    )
    # A hot key may be a line repeated in few documents: its holders are counted exactly, from rows with one per document.
    held = (
        lines.join(hot, key).select(*key, "doc_id").distinct()
        .groupBy(*key).agg(F.count("*").alias("holders"))
        .where(F.col("holders") >= min_docs)
    )
    warm = (
        lines.join(hot.join(held, key, "left_semi"), key)
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .select(*_DOC, "pos")
    )
    return cold.unionByName(warm)


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """doc_id, text_hash, words: map from pos div 64 to the bits of dropped lines; documents without any have no row."""
    words = (
        dropped_lines(docs, min_chars, min_docs, hot_lines)
        .groupBy(*_DOC, F.shiftright("pos", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits"))
    )
    return words.groupBy(*_DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    r"""docs with the columns n_lines, n_dropped and kept_text added (they replace columns of these names).

    A text is split at \n; a null or empty text is one empty line. The key
    of a line has white space stripped and A-Z lower-cased. Keys of at least
    min_chars characters in at least min_docs documents lose all lines but
    those in the largest doc_id that holds them. Rows of one doc_id count as
    one document; a null doc_id is smaller than any other. Repeated rows stay
    and are treated alike; no rows give no rows. A long text is many lines, as
    rows of their own, and is only joined again for the task that writes it.
    """
    return deduped(docs.drop("n_lines", "n_dropped", "kept_text"), min_chars, min_docs, hot_lines).select("row.*", "n_lines", "n_dropped", "kept_text")


def deduped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_lines: int = HOT_LINES) -> DataFrame:
    """row (all columns of docs), n_lines, n_dropped, kept_text."""
    text = F.coalesce("text", F.lit(""))
    maps = drop_bitmaps(docs.select("doc_id", text.alias("text")), min_chars, min_docs, hot_lines).select(
        F.col("doc_id").alias("to"), F.col("text_hash").alias("to_hash"), "words"
    )
    # Only the row itself meets its map; lines are split after that.
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text).alias("own_hash"))
    own = own.join(maps, F.col("own_id").eqNullSafe(F.col("to")) & (F.col("own_hash") == F.col("to_hash")), "left")
    own = own.select("row", "words", F.split(F.coalesce("row.text", F.lit("")), "\n").alias("lines"))
    kept = F.when(F.col("words").isNull(), F.col("lines")).otherwise(
        F.expr("filter(lines, (x, i) -> coalesce(shiftright(element_at(words, shiftright(i, 6)), i & 63) & 1L, 0L) = 0L)")
    )
    own = own.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return own.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document. See dedup_lines() for odd rows."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT k, doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT k, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
y AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT y.*, h.last IS NOT NULL AND y.doc_id <> h.last AS gone FROM y LEFT JOIN h ON y.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY k, doc_id
"""

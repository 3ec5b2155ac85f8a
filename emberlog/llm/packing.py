"""Best-fit packing of token sequences, by lengths that are counted rather than listed.

Documents become pieces of at most the sequence length. How many pieces have
each length is all that packing needs, so bins are planned as patterns of
lengths with a multiplicity: a plan has a few thousand patterns, however many
documents there are. Pieces are then ranked within their length, and the rank
names pattern, copy and offset.

A pattern is filled greedily, largest piece that fits first. If a gap is left,
the smallest piece in the bin is replaced with two others that fill its
place and the gap more tightly, while that helps (best-two-fit).
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table
from emberlog.llm.textops import by_slice
from emberlog.llm.tokens import Encoder

SEQUENCE = 1024
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Ranks within a length are counted in groups of about GROUP_ROWS pieces, or larger ones where there would be more than MOST_GROUPS, so that no task ranks a frequent length alone.
GROUP_ROWS, MOST_GROUPS = 2_000, 50_000


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones, but for the first."""
    first = n % most or most
    return [(0, first)] + [(k, most) for k in range(first, n, most)]


def _pair(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths of left (counts by length) with the largest sum up to room, or zeros."""
    have = np.flatnonzero(left[: room + 1])
    have = have[have > 0]
    best = (0, 0)
    if len(have) == 0:
        return best
    fit = np.searchsorted(have, room - have, side="right") - 1
    for step in (0, 1):  # the same length twice needs two pieces
        f = fit - step
        ok = f >= 0
        other = have[np.maximum(f, 0)]
        ok &= (other != have) | (left[have] >= 2)
        total = np.where(ok, have + other, 0)
        k = int(np.argmax(total))
        if total[k] > sum(best):
            best = int(have[k]), int(other[k])
    return best


def plan(counts: np.ndarray, most: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one bin) and how often each is used; counts: pieces by length 0 to most."""
    left, patterns = counts.astype(np.int64).copy(), []
    while (have := np.flatnonzero(left)).size:
        bin_ = [int(have[-1])]
        left[bin_[0]] -= 1
        gap = most - bin_[0]
        while gap:
            fit = np.flatnonzero(left[: gap + 1])
            if not fit.size:
                break
            bin_.append(int(fit[-1]))
            left[fit[-1]] -= 1
            gap -= int(fit[-1])
        while gap and len(bin_) > 1:
            small = bin_[-1]
            a, b = _pair(left, gap + small)
            if a + b <= small:
                break
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            gap -= a + b - small
            bin_ = sorted([*bin_[:-1], a, b], reverse=True)
        lengths, used = np.unique(bin_, return_counts=True)
        times = 1 + int((left[lengths] // used).min())
        left[lengths] -= used * (times - 1)
        patterns.append((bin_, times))
    return patterns


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with_ids: ids, little-endian unsigned 32-bit) for each row of docs; a null text is empty and has its end id alone."""
    schema = docs.select("doc_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for k, x in enumerate(Encoder.of(tokenizer, spaces=True).encode(texts)):
            ids = x.tobytes() + end
            for n, (start, length) in enumerate(cut(len(ids) // 4, most)):
                own = ids[4 * start : 4 * (start + length)]
                rows.append((k, n, start, length, zlib.crc32(own), own if with_ids else None))
        at, n, start, length, crc, own = zip(*rows, strict=True)
        columns = [part.column(0).take(pa.array(at)), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        if with_ids:
            columns.append(pa.array(own, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(by_slice(run), schema)


def pack(found: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """found (doc_id, piece, length and row_salt at least, computed once) with sequence_id and offset added and row_salt left out. row_salt tells rows apart, equal ones too, so that they share no rank group."""
    spark = found.sparkSession
    counts = np.zeros(most + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most as many rows as lengths
        counts[r["length"]] = r["n"]
    rows = max(GROUP_ROWS, int(counts.sum()) // MOST_GROUPS)
    groups = [(n, int(c) // rows + 1) for n, c in enumerate(counts.tolist()) if c]
    groups = F.broadcast(spark.createDataFrame(groups, "length long, rank_groups int"))
    own = F.pmod(F.xxhash64("row_salt"), F.col("rank_groups")).cast("int")
    keyed = found.join(groups, "length").withColumn("rank_group", own)
    seen, base = np.zeros(most + 1, np.int64), []
    for r in sorted(keyed.groupBy("length", "rank_group").agg(F.count("*").alias("n")).collect()):  # at most MOST_GROUPS more
        base.append((r["length"], r["rank_group"], int(seen[r["length"]])))
        seen[r["length"]] += r["n"]
    given, slots, sequence = np.zeros(most + 1, np.int64), [], 0
    for lengths, times in plan(counts, most):
        offset = 0
        for n in lengths:
            slots.append((n, int(given[n]), int(given[n]) + times, sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    # Both tables are bounded by the sequence length and MOST_GROUPS, not by the input.
    base = F.broadcast(spark.createDataFrame(base, "length long, rank_group int, base long"))
    slots = F.broadcast(spark.createDataFrame(slots, "slot_length long, low long, high long, sequence long, offset long"))
    ranked = (
        keyed.withColumn("nth", F.row_number().over(W.partitionBy("length", "rank_group").orderBy("doc_id", "piece")))
        .join(base, ["length", "rank_group"])
        .withColumn("rank", F.col("base") + F.col("nth") - 1)
    )
    placed = ranked.join(
        slots,
        (ranked["length"] == slots["slot_length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    return placed.select(*(c for c in found.columns if c != "row_salt"), (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, most: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed each; a null doc_id stays null.

    A null text is an empty one; a long text is encoded as a whole and cut; other columns
    are ignored, whatever their names; no rows give no rows.
    """
    found = pieces(docs, tokenizer, end_id, most, with_ids).withColumn("row_salt", F.monotonically_increasing_id())
    return pack(stored(found, "pieces"), most)  # stored, so that a row keeps its salt


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of whole sequences, from pack_documents(with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document. See pack_documents() for odd rows."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

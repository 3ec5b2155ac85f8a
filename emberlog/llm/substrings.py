"""Removal of long repeated substrings, with run-length indexes of the repetitive part of a corpus.

Every stretch of 100 bytes belongs to a run of stretches that share their
least hash of 24 bytes (its key); equal stretches have equal keys. Runs whose
key no other run has are unique and go no further. Equal runs are summed up
to their first place. What is left, different runs of one key, is indexed:
a run-compressed Burrows-Wheeler transform with samples where its runs begin
streams the matches of every position, and in each class of equal stretches
all but the first are marked. The runs of a key with more of them than an
index takes are cut in halves that share longer seeds, until each seed's fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table, tasks
from emberlog.llm.rindex import first_places, symbols
from emberlog.llm.textops import Rolling, Texts, by_slice

LENGTH, SEED = 100, 24
#: Different runs of one key that are indexed together; more get longer seeds.
SPLIT_RUNS = 512
#: Bytes of one index.
INDEX_BYTES = 1 << 20
#: Longest run (in stretches), so that it fits one byte.
_MOST = 255
# A place packs a flag, 32 bits of start and 8 bits of length.
_START_SHIFT, _FLAG_SHIFT = 8, 40
#: Stands for a null doc_id, before all others.
_NULL_ID = -(1 << 63)


def runs(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Text number, key, start in the text, stretches, hash and whether the key's bytes recur inside, for each run of stretches."""
    docs = Texts(texts)
    n, width = len(docs.data), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 6
    rolling = Rolling(docs.data)
    start = np.arange(n - seed + 1)
    hashes = rolling.of(start, start + seed)
    least, w = hashes, 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if width > w:
        least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
    here = np.repeat(np.arange(docs.n), np.diff(docs.bounds))[: len(least)]
    place = np.arange(len(least)) - docs.bounds[here]
    fits = np.arange(len(least)) + length < docs.bounds[here + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (here[1:] != here[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(least)), 0))
    new |= (np.arange(len(least)) - head) % _MOST == 0
    first = np.flatnonzero(new & fits)
    stop = np.flatnonzero(new | ~fits)
    end = np.append(stop, len(least))[np.searchsorted(stop, first, side="right")]
    key = least[first]
    twice = _count(hashes, least, width, key, first, end - 1 + width) > 1
    return docs.doc_of(first), key, place[first], end - first, rolling.of(first, end + length - 1), twice


def _count(hashes: np.ndarray, least: np.ndarray, width: int, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How often each key occurs from low to high: more than once only where its bytes recur inside a run."""
    edge, w = np.zeros(width - 1, np.uint64), 1
    most = np.concatenate([edge, least, edge])  # becomes the largest of the least hashes of the stretches around a position
    while 2 * w <= width:
        most = np.maximum(most[:-w], most[w:])
        w *= 2
    if width > w:
        most = np.maximum(most[: len(most) - (width - w)], most[width - w :])
    places = np.flatnonzero(hashes == most[: len(hashes)])  # only there keys stand
    names, number = np.unique(hashes[places], return_inverse=True)
    at = np.sort(number << 32 | places)
    own = np.searchsorted(names, key) << 32
    return np.searchsorted(at, own | high) - np.searchsorted(at, own | low)


def _own(docs: DataFrame) -> DataFrame:
    """doc, variant, text of each row: variant is the text's hash where other rows have the same doc_id or it is null, else 0."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), text.alias("text"))
    shared = own.groupBy("doc").agg(F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("doc") == _NULL_ID))
    shared = stored(shared.select(F.col("doc").alias("of")), "shared-ids")
    variant = F.when(F.col("of").isNull(), 0).otherwise(F.xxhash64("text")).cast("long")
    return own.join(shared, F.col("doc") == F.col("of"), "left").select("doc", variant.alias("variant"), "text")


def all_runs(own: DataFrame, length: int, seed: int) -> DataFrame:
    """key, hash, doc, variant, place of every run of every document."""

    def find(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        n, key, start, size, hashed, twice = runs(texts, length, seed)
        doc, variant = (part.column(k).to_numpy(zero_copy_only=False)[n] for k in (0, 1))
        place = twice.astype(np.int64) << _FLAG_SHIFT | start << _START_SHIFT | size
        columns = (key.view(np.int64), hashed.view(np.int64), doc, variant, place)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "hash", "doc", "variant", "place"])

    return own.mapInArrow(by_slice(find), "key long, hash long, doc long, variant long, place long")


def _start() -> Column:
    return F.shiftright("place", _START_SHIFT).bitwiseAND(F.lit(0xFFFFFFFF))


def _size() -> Column:
    return F.col("place").bitwiseAND(F.lit(0xFF))


def _twice() -> Column:
    return F.shiftright("place", _FLAG_SHIFT)


_SPANS = "doc long, variant long, start long, stretches long"


def _indexed(length: int):
    """For mapInArrow over runs (key, doc, variant, start, bytes) sorted by all but the bytes: stretches that repeat an earlier one of their key."""

    def work(rows: list[list]) -> pa.RecordBatch:
        *places, parts = zip(*rows, strict=True)
        key, doc, variant, start = (np.concatenate(x) for x in places)
        parts = [x for part in parts for x in part]
        # rows of one document stand several times where it does
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]) | (start[1:] != start[:-1])
        once = np.flatnonzero(new)
        doc, variant, start, parts = doc[once], variant[once], start[once], [parts[k] for k in once]
        text, begin = symbols(parts)
        stretches = np.array([len(p) - length + 1 for p in parts], np.int64)
        row = np.repeat(np.arange(len(parts)), stretches)
        positions = np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches) + begin[row]
        again = first_places(text, positions, length) != positions
        # as ranges of neighbours
        p, r = positions[again], row[again]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        size, r, p = np.diff(np.append(at, len(p))), r[at], p[at]
        columns = (doc[r], variant[r], start[r] + p - begin[r], size)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "variant", "start", "stretches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        size = 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            for at, end in _pieces(key):
                if rows and size >= INDEX_BYTES and key[at] != rows[-1][0][-1]:
                    yield work(rows)
                    rows, size = [], 0
                part = batch.slice(at, end - at)
                rows.append([*(part.column(k).to_numpy() for k in range(4)), part.column(4).to_pylist()])
                size += sum(map(len, rows[-1][4]))
        if rows:
            yield work(rows)

    return run


def _pieces(key: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that begin where a key does, a few hundred rows each (one key's are never parted)."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    starts = starts[np.append(True, np.diff(starts // 256) > 0)] if len(starts) else starts
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True))


_RUNS = "key long, hash long, doc long, variant long, start long, anchor int, low int, high int, bytes binary"


def _halved(length: int, seed: int):
    """For mapInArrow over runs (key, doc, variant, start, anchor, low, high, bytes): each in parts whose stretches share more than the key.

    The anchor is where the first 24 bytes that made the key stand, so a
    stretch has some bytes to the left of it, between low and high. Stretches
    of the upper half share the middle number of bytes to the left, those of
    the lower half more bytes to the right: with them the seed is longer, and
    the part's new key. Equal stretches have equal anchors, so they stay
    together; after seven times a seed is a whole stretch. A run of which only
    the key is known (anchor null) is cut where the anchor changes before.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, doc, variant, start = (batch.column(k).to_numpy() for k in range(4))
        parts = batch.column(7).to_pylist()
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        rolling = Rolling(np.frombuffer(b"".join(parts), np.uint8))
        if batch.column(4).null_count:  # all of them
            row = np.repeat(np.arange(len(parts)), sizes - length + 1)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + begin[row]
            where = np.arange(int(sizes.sum()) - seed + 1)
            of = np.repeat(np.arange(len(parts)), sizes)[: len(where)]
            places = np.flatnonzero(rolling.of(where, where + seed).view(np.int64) == key[of])
            anchor = places[np.searchsorted(places, at)]
            new = np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))
            first = np.flatnonzero(new)
            last = at[np.append(first[1:], len(at)) - 1]
            row, anchor, first = row[first], anchor[first], at[first]
            low, high = np.zeros(len(row), np.int64), np.full(len(row), length - seed)
        else:
            row, first, last = np.arange(len(parts)), begin, begin + sizes - length
            anchor = begin + batch.column(4).to_numpy()
            low, high = (batch.column(k).to_numpy().astype(np.int64) for k in (5, 6))
        middle = (low + high + 1) // 2
        row, first, last, anchor = (np.tile(x, 2) for x in (row, first, last, anchor))
        low, high = np.concatenate([middle, low]), np.concatenate([high, middle - 1])
        first, last = np.maximum(first, anchor - high), np.minimum(last, anchor - low)
        some = first <= last
        row, first, last, anchor, low, high = (x[some] for x in (row, first, last, anchor, low, high))
        own = rolling.of(anchor - low, anchor + length - high)
        whole = rolling.of(first, last + length)
        pieces = [parts[r][a:b] for r, a, b in zip(row.tolist(), (first - begin[row]).tolist(), (last + length - begin[row]).tolist(), strict=True)]
        columns = [own.view(np.int64), whole.view(np.int64), doc[row], variant[row], start[row] + first - begin[row]]
        columns += [x.astype(np.int32) for x in (anchor - first, low, high)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(pieces, pa.binary())],
            names=["key", "hash", "doc", "variant", "start", "anchor", "low", "high", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield cut(batch)

    return run


def repeated_spans(own: DataFrame, length: int = LENGTH, seed: int = SEED, split_runs: int = SPLIT_RUNS) -> DataFrame:
    """doc, variant, start, end: bytes of own (doc, variant, text) that a stretch covers which also starts earlier (spans may overlap)."""
    columns = ["doc", "variant", "start", "stretches"]
    place = F.struct("doc", "variant", "start")
    found = all_runs(own, length, seed)
    # what others are joined with is stored first, so that a frequent key's rows can be split over tasks
    keys = stored(found.groupBy("key").agg(F.sum(1 + _twice()).alias("n")).where("n > 1").select("key"), "keys")
    repeats = stored(found.join(keys, "key").select("key", "hash", "doc", "variant", _start().alias("start"), _size().alias("stretches"), _twice().alias("twice")), "repeats")
    first = F.min(F.struct("doc", "variant", "start", "stretches", "twice"))
    distinct = stored(repeats.groupBy("key", "hash").agg(first.alias("first")).select("key", "hash", "first.*"), "runs")
    # later copies of a run: all of their stretches go
    spans = [repeats.join(distinct.select("key", "hash", place.alias("first")), ["key", "hash"]).where(place != F.col("first")).select(*columns)]
    texts = own.select(F.col("doc").alias("of"), F.col("variant").alias("of_variant"), "text")
    bytes_ = F.expr(f"substring(text, cast(start + 1 as int), cast(stretches + {length - 1} as int))").alias("bytes")

    def sized(runs: DataFrame, more_than_one: str = "n > 1") -> DataFrame:
        twice = F.max("twice" if "twice" in runs.columns else F.lit(0)).alias("twice")
        groups = runs.groupBy("key").agg(F.count("*").alias("n"), twice).where(more_than_one)
        return stored(groups.select("key", (F.col("n") > split_runs).alias("many")), "groups")

    groups = sized(distinct, "n > 1 or twice = 1")
    runs_ = distinct.join(groups, "key").join(texts, (F.col("doc") == F.col("of")) & (F.col("variant") == F.col("of_variant")))
    none = F.lit(None).cast("int")
    runs_ = stored(runs_.select("key", "doc", "variant", "start", none.alias("anchor"), none.alias("low"), none.alias("high"), bytes_, "many"), "cut-runs")
    fit = [runs_.where("not many")]
    while groups.where("many").limit(1).count():
        cut = stored(runs_.where("many").drop("many").mapInArrow(_halved(length, seed), _RUNS), "halves")
        rest = ["doc", "variant", "start", "anchor", "low", "high", "bytes"]
        runs_ = stored(cut.groupBy("key", "hash").agg(F.min(F.struct(*rest)).alias("first")).select("key", "hash", "first.*"), "runs")
        again = cut.join(runs_.select("key", "hash", place.alias("first")), ["key", "hash"]).where(place != F.col("first"))
        spans.append(again.select("doc", "variant", "start", (F.length("bytes") - length + 1).cast("long").alias("stretches")))
        groups = sized(runs_)
        runs_ = stored(runs_.drop("hash").join(groups, "key"), "cut-runs")
        fit.append(runs_.where("not many"))
    order = ["key", "doc", "variant", "start"]
    dealt = reduce(DataFrame.unionByName, fit).select(*order, "bytes").repartition(tasks(own), "key").sortWithinPartitions(*order)
    spans.append(dealt.mapInArrow(_indexed(length), _SPANS))
    every = reduce(DataFrame.unionByName, spans)
    return every.select("doc", "variant", "start", (F.col("start") + F.col("stretches") + length - 1).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, split_runs: int = SPLIT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs.

    Removed is every byte of a stretch of length bytes that also starts
    earlier: in a smaller doc_id, or in the same document further left. A
    doc_id is an integer; a null one is smaller than any other; rows of one
    doc_id (or of none) with different texts follow one another by their
    texts' 64-bit hashes, and equal rows are one document. A null text is
    empty; a text is worked on as a whole in one task. No rows give no rows.
    Other columns of docs are ignored, whatever their names.
    """
    own = _own(docs.select("doc_id", "text"))
    spans = stored(
        repeated_spans(own, length, seed, split_runs)
        .groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        .select(F.col("doc").alias("of"), F.col("variant").alias("of_variant"), "spans"),
        "spans",
    )
    joined = own.join(spans, (F.col("doc") == F.col("of")) & (F.col("variant") == F.col("of_variant")), "left")

    def cut(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        rows = []
        for text, own_spans in zip(texts, part.column(2).to_pylist(), strict=True):
            if not own_spans:
                rows.append((len(text), 0, 0, text))
                continue
            steps = np.zeros(len(text) + 1, np.int64)
            np.add.at(steps, [s["start"] for s in own_spans], 1)
            np.add.at(steps, [s["end"] for s in own_spans], -1)
            gone = np.cumsum(steps)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
        n, removed, spans_, kept = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans_)), pa.array(kept, pa.binary())],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    done = joined.select("doc", "text", "spans").mapInArrow(
        by_slice(cut), "doc long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    doc_id = F.when(F.col("doc") != F.lit(_NULL_ID), F.col("doc"))
    return done.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 100-byte strings leave of every document. See remove_repeats() for odd rows."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, i, b[i:i + 99] AS g FROM (SELECT k, b, unnest(range(1, octet_length(b)::BIGINT - 98)) AS i FROM d)),
r AS (SELECT k, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY k, i) > 1),
s AS (SELECT k, i, coalesce(i > 100 + lag(i) OVER (PARTITION BY k ORDER BY i), true) AS new FROM r),
n AS (SELECT k, i, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM s),
x AS (SELECT k, run, min(i) AS a, max(i) + 99 AS z FROM n GROUP BY k, run),
y AS (SELECT x.*, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) + 1 AS kept_a FROM x),
e AS (SELECT y.k, kept_a AS a, y.a - 1 AS z FROM y UNION ALL SELECT d.k, coalesce(max(y.z), 0) + 1, any_value(octet_length(b)) FROM d LEFT JOIN y ON d.k = y.k GROUP BY d.k),
t AS (SELECT d.k, string_agg(CASE WHEN e.z >= e.a THEN hex(b[e.a:e.z]) ELSE '' END, '' ORDER BY e.a) AS kept FROM d JOIN e ON d.k = e.k GROUP BY d.k),
c AS (SELECT k, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM x GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON d.k = t.k LEFT JOIN c ON d.k = c.k
"""

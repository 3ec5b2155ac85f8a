"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments of a few MB: each segment is one row with
its sorted terms and, for each, the ascending positions at which it occurs.
The index is written to the shared folder. Test items, a bounded block of
them at a time, are looked up in every segment: the postings of a window's
rarest term, moved back by its offset, are candidates, and the other terms'
lists, rarest first, are intersected with them at their own offsets.
Intersecting with some slack gives proximity matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table
from emberlog.llm.textops import Rolling, Texts, by_slice

WINDOW, SLACK = 10, 3
SEGMENT_BYTES = 2 << 20
#: Bytes of test items that are collected and sent to the tasks at once; larger sets take several passes over the index.
BLOCK_BYTES = 16 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_INDEX = "segment string, doc_ids array<long>, ends binary, terms binary, counts binary, positions binary"


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and for each text where its words end."""
    docs = Texts(texts)
    starts, ends = docs.spans(_WORD)
    return Rolling(docs.data, lower=True).of(starts, ends), np.searchsorted(starts, docs.bounds[1:])


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index over docs (doc_id, text): one row for each segment; positions count the words of the segment."""

    def build(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        term, ends = words(texts)
        order = np.argsort(term, kind="stable").astype(np.uint32)
        terms, counts = np.unique(term[order], return_counts=True)
        columns = [[uuid.uuid4().hex], [part.column(0).cast(pa.int64()).to_pylist()]]
        columns += [[x.tobytes()] for x in (ends.astype("<u4"), terms.astype("<u8"), counts.astype("<u4"), order.astype("<u4"))]
        kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
            names=["segment", "doc_ids", "ends", "terms", "counts", "positions"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(own.mapInArrow(by_slice(build, most=segment_bytes), _INDEX), "index")


class Windows(NamedTuple):
    """Windows of test items as arrays: for each length, a row of term numbers for each distinct window, where its items begin among items (and the last ones end), and those."""

    terms: np.ndarray
    rows: list[np.ndarray]
    first: list[np.ndarray]
    items: list[np.ndarray]
    names: list[str]


def windows(ids: list, texts: list[str | None], window: int = WINDOW) -> Windows:
    """The windows of items; some 140 bytes for each word of the texts while they are sorted, and no objects of their own."""
    names = sorted({"" if i is None else str(i) for i in ids})
    number = {x: k for k, x in enumerate(names)}
    item = np.array([number["" if i is None else str(i)] for i in ids], np.int32)
    all_terms, ends = words([(t or "").encode() for t in texts])
    terms, all_terms = np.unique(all_terms, return_inverse=True)
    all_terms = all_terms.astype(np.int32)
    begin = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
    size = np.minimum(ends - begin, window)
    rows, first, items = [], [], []
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        many = (ends - begin)[own] - n + 1
        text = np.repeat(own, many)
        start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many - begin[own], many)
        order = np.lexsort([all_terms[start + k] for k in range(n)])
        every = all_terms[start[order, None] + np.arange(n)]
        new = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
        # items of a window, each once: its number in the high bits, the item in the low ones
        both = np.unique((np.cumsum(new) - 1) << 32 | item[text[order]])
        rows.append(every[new])
        first.append(np.searchsorted(both >> 32, np.arange(len(rows[-1]) + 1)))
        items.append((both & 0xFFFFFFFF).astype(np.int32))
    return Windows(terms, rows, first, items, names)


class Segment:
    def __init__(self, ends: bytes, terms: bytes, counts: bytes, positions: bytes):
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<u8")
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        #: Ascending: positions within terms.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def match(self, rows: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which windows (rows of this segment's term numbers, none missing) occur from which word on in which document, each term within slack words of its place and in that document."""
        size = self.counts[rows]
        order = np.argsort(size, axis=1, kind="stable")  # offsets, the rarest term's first
        rare = rows[np.arange(len(rows)), order[:, 0]]
        n = self.counts[rare]
        row = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(self.first[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        position = self.positions[at]
        doc = np.searchsorted(self.ends, position, side="right")
        found = row, position - order[row, 0], doc
        if slack:
            # the rarest term too may be off its place: the others are within twice the slack of where it points to
            row, start, doc = self._standing(rows, order, *found, 2 * slack)
            shifts = np.arange(-slack, slack + 1)
            found = np.repeat(row, len(shifts)), (start[:, None] + shifts).ravel(), np.repeat(doc, len(shifts))
        return self._standing(rows, order, *found, slack)

    def _standing(self, rows: np.ndarray, order: np.ndarray, row: np.ndarray, start: np.ndarray, doc: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidates (window, first word, document) those with all terms but the rarest within slack words of their places and in the document."""
        begin = np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]
        go = (start >= begin[doc] - slack) & (start + rows.shape[1] <= self.ends[doc] + slack)
        row, start, doc = row[go], start[go], doc[go]
        for k in range(1, rows.shape[1]):
            if not len(row):
                break
            offset = order[row, k]
            term, place = rows[row, offset] << 32, start + offset
            least, most = np.maximum(place - slack, begin[doc]), np.minimum(place + slack, self.ends[doc] - 1)
            low = np.searchsorted(self.keys, term | least)
            found = self.keys[np.minimum(low, len(self.keys) - 1)]
            go = (least <= most) & (low < len(self.keys)) & (found >= term | least) & (found <= term | most)
            row, start, doc = row[go], start[go], doc[go]
        return row, start, doc


def _hits(segment: Segment, query: Windows, slack: int) -> tuple[dict, dict, dict]:
    """By document: exact spans (start, end), items of exact matches, items of proximity matches."""
    numbers = segment.lists(query.terms)
    spans: dict[int, list] = {}
    exact: dict[int, set] = {}
    near: dict[int, set] = {}
    first = np.concatenate([[0], segment.ends[:-1]]) if len(segment.ends) else segment.ends
    for terms, at, items in zip(query.rows, query.first, query.items, strict=True):
        rows = numbers[terms]
        here = np.flatnonzero((rows >= 0).all(axis=1))
        if not len(here):
            continue
        for tolerance, of in ((0, exact), *(((slack, near),) if slack else ())):
            row, start, doc = segment.match(rows[here], tolerance)
            for r, s, d in zip(here[row].tolist(), start.tolist(), doc.tolist(), strict=True):
                of.setdefault(d, set()).update(items[at[r] : at[r + 1]].tolist())
                if not tolerance:
                    s -= int(first[d])
                    spans.setdefault(d, []).append((s, s + terms.shape[1]))
    return spans, exact, near


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_FOUND = "segment string, nth int, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def find(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged word ranges of exact matches), items, near_items (distinct ids as strings, sorted) for each indexed document.

    items: item_id, text. A window is window consecutive words of an item,
    or a shorter item as a whole; items without words have none. A null
    item_id counts as the empty string; rows of one id are one item. An item
    is near a document if there is a place for one of its windows such that
    each word of the window stands in the document within slack words of its
    own place (equal words may share one). Where documents are cut into
    segments plays no part.
    """
    spark = index.sparkSession
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = pa.list_(pa.string())
    found = []
    for b in range(blocks):
        of = items.where(F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(blocks)) == b).collect()  # about block_bytes
        query = spark.sparkContext.broadcast(windows([r[0] for r in of], [r[1] for r in of], window))

        def look(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    name, doc_ids, *parts = (c[k].as_py() for c in batch.columns)
                    segment = Segment(*parts)
                    spans, exact, near = _hits(segment, query.value, slack)
                    every = query.value.names
                    n = len(doc_ids)
                    text = lambda of: pa.array([sorted(every[i] for i in of.get(d, ())) for d in range(n)], names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * n),
                            pa.array(range(n), pa.int32()),
                            pa.array(doc_ids, pa.int64()),
                            pa.array(np.diff(segment.ends, prepend=0)),
                            pa.array([[{"start": s, "end": e} for s, e in _merged(spans.get(d, []))] for d in range(n)], kind),
                            text(exact),
                            text(near),
                        ],
                        names=["segment", "nth", "doc_id", "n_words", "spans", "items", "near_items"],
                    )

        found.append(index.mapInArrow(look, _FOUND))
    if blocks == 1:
        return found[0].drop("segment", "nth")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    merge = F.expr(
        """aggregate(array_sort(spans), cast(array() as array<struct<start:int,end:int>>), (a, s) ->
           if(size(a) > 0 and s.start <= element_at(a, -1).end,
              concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))),
              concat(a, array(s))))"""
    )
    return (
        every.groupBy("segment", "nth", "doc_id", "n_words")
        .agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        )
        .select("doc_id", "n_words", merge.alias("spans"), "items", "near_items")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """find() over docs (doc_id, text), with n_hit and contaminated.

    A doc_id is an integer or null. A null or empty text has no words and no
    hits; a long one is indexed as a whole, in one segment. Repeated rows stay; other columns are ignored, whatever their
    names; no documents give no rows, no items no hits.
    """
    found = find(build_index(docs), items, window, slack)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document, exact and near. See contamination() for odd rows."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, ws[i:i + least(10, len(ws)) - 1] AS g FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, n, i, ws[i:i + n - 1] AS g FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT dw.k, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, i + unnest(range(0, n)) AS place FROM h) GROUP BY k),
q AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k),
t AS (SELECT k, i, ws[i] AS w FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
r AS (SELECT x.n, g, arg_min(o, (coalesce(c.n, 0), o)) AS o FROM (SELECT n, g, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT n, g FROM bw)) x LEFT JOIN c ON c.w = g[o] GROUP BY x.n, g),
a AS (SELECT DISTINCT t.k, n, g, i - o + 1 - unnest(range(-3, 4)) AS s FROM r JOIN t ON t.w = g[o]),
m AS (SELECT DISTINCT a.k, n, g FROM a JOIN d ON a.k = d.k WHERE list_bool_and([list_contains(ws[greatest(1, s + j - 4):greatest(0, s + j + 2)], g[j]) FOR j IN range(1, n + 1)])),
z AS (SELECT k, count(DISTINCT item) AS n_near_items, string_agg(DISTINCT item, ',' ORDER BY item) AS near_items FROM m JOIN bw ON m.n = bw.n AND m.g = bw.g GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256
FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN q ON d.k = q.k LEFT JOIN z ON d.k = z.k
"""

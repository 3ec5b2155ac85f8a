"""MinHash near-dedup with SuperMinHash signatures.

Each shingle of a set deals its ranks 0, 1, 2, ... to the slots of the
signature in an order of its own (a shuffle that the shingle seeds); a slot
keeps the least rank, with a random fraction, that any shingle of the set gave
it. A shingle's ranks are a permutation, so slots aren't independent, and the
share of equal slots estimates the similarity with less variance than
independent hashes do. A set stops dealing as soon as all its slots are taken:
later ranks are larger.

Groups of slots are bands; sets with an equal band are candidates, compared by
one bit of each slot and confirmed on the full sets. Links are reduced to
forests by union-find in each task, and these are grouped across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import joined_by, stored, table
from emberlog.llm.components import components
from emberlog.llm.simhash import HOT_BUCKET, set_name, wide_links
from emberlog.llm.textops import Rolling, Texts, by_slice, grams, mix

SHINGLE, SIMILARITY = 3, 0.85
#: Slots of a signature, and of a band. Of two sets that share 0.85 of their shingles a band is equal with a probability of 0.85^6; that none
#: of the 42 is, happens once in 4 * 10^8 such pairs. Sets that share half of theirs meet in half of all cases, those that share 0.3 in 3 %.
SLOTS, BAND = 256, 6
#: Of the slots' bits of a pair at 0.85, 19 of 256 differ on average; more than RADIUS do once in 7 * 10^9 pairs.
RADIUS = 50
#: Bytes of text whose shingles are worked on at once; while dealing, a shingle has a byte for each slot.
_SLICE = 1 << 18
_U = np.uint64
_FREE = ~_U(0)


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text as sorted distinct 64-bit hashes of its runs of shingle words, A-Z in lower case; fewer words make one, none make none."""
    docs = Texts(texts)
    starts, ends = docs.spans(_WORD)
    word, doc = Rolling(docs.data, lower=True).of(starts, ends), docs.doc_of(starts)
    n = np.bincount(doc, minlength=docs.n)
    first = np.concatenate([[0], np.cumsum(n)])
    runs = grams(word, shingle)
    whole = doc[: len(runs)] == doc[shingle - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.concatenate([[0], np.cumsum(whole)])
    runs = runs[whole]
    out = []
    for k in range(docs.n):
        if n[k] >= shingle:
            out.append(np.unique(runs[at[first[k]] : at[first[k + 1] - shingle + 1]]))
        else:
            out.append(mix(grams(word[first[k] : first[k + 1]], int(n[k])) + _U(n[k])) if n[k] else np.zeros(0, _U))
    return out


_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots) of sets of distinct hashes; a slot is the rank above 32 bits of fraction. An empty set has all bits of all slots.

    All shingles of all sets deal a rank at a time. slots is 256 at most.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    seed = mix(np.concatenate([*sets, np.zeros(0, _U)]).astype(_U))
    of = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * slots, _FREE, _U)
    by_set = out.reshape(len(sets), slots)
    order, row = None, None  # order[row]: a shingle's slots, those dealt first
    for rank in range(slots):
        if not len(of):
            break
        random = mix(seed + _U((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (rank + (((random >> _U(32)) * _U(slots - rank)) >> _U(32)).astype(np.int64)).astype(np.int64)
        if rank == 0:
            slot = pick
        else:
            if order is None:  # only of the sets that weren't done after rank 0
                order, row = np.tile(np.arange(slots, dtype=np.uint8), (len(of), 1)), np.arange(len(of))
                order[row, first], order[:, 0] = 0, first
            slot, back = order[row, pick], order[row, rank]
            order[row, rank], order[row, pick] = slot, back
            slot = slot.astype(np.int64)
        np.minimum.at(out, of * slots + slot, (_U(rank) << _U(32)) | (random & _U(0xFFFFFFFF)))
        left = np.zeros(len(sets), bool)
        some = np.unique(of)
        left[some] = (by_set[some] == _FREE).any(1)
        go = left[of]
        of, seed = of[go], seed[go]
        if rank == 0:
            first = slot[go]
        else:
            row = row[go]
    return by_set


def bands(signatures: np.ndarray, size: int = BAND) -> np.ndarray:
    """A hash of each band (sets x bands) of size slots; slots that are left over have no band."""
    n = signatures.shape[1] // size
    own = signatures[:, : n * size].reshape(len(signatures), n, size)
    out = np.broadcast_to(np.arange(n, dtype=_U), (len(signatures), n)).copy()
    for k in range(size):
        out = mix(out ^ own[:, :, k]) * _U(0x9E3779B97F4A7C15)
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (the name of the set; null if it is empty), n_shingles, fp (a bit of each slot; binary), signatures (hashes of the bands) of each row of docs."""
    schema = docs.select("doc_id").schema
    for name, kind in (("text_hash", "long"), ("node", "long"), ("n_shingles", "long"), ("fp", "binary")):
        schema = schema.add(name, kind)
    schema = schema.add("signatures", T.ArrayType(T.LongType()))

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = shingle_hashes(texts, shingle)
        slots = super_minhash(sets)
        bits = np.packbits((mix(slots) & _U(1)).astype(np.uint8), axis=1, bitorder="little")
        sizes = [len(s) for s in sets]
        columns = [
            pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary()),
            pa.array([b if n else [] for b, n in zip(bands(slots).view(np.int64), sizes, strict=True)], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(by_slice(run, most=_SLICE), schema)


def forest(links: DataFrame, block: int = 1 << 20) -> DataFrame:
    """a, b: of each task's links those that union-find needs to connect what all of them connect, in blocks that bound its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)  # path halving
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append((a, b))
            if len(parent) > block:
                parent = {}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Two rows are linked if their sets of distinct shingles have a similarity
    (intersection by union) of similarity or more; component_id is the smallest
    doc_id reachable. Null and empty texts and those without words have no shingles, no
    links and their own id. Rows with a null doc_id link others; a component
    of such rows alone has a null id. kept: doc_id is component_id (so all
    rows of that id stay). Other columns are ignored, no rows give no rows. A
    text, however long, is worked on as a whole; equal sets are one node, so copies cost one row each.
    """
    found = stored(sketches(docs, shingle), "sketches")
    nodes = found.where("node is not null")
    own = nodes.select("node", "doc_id", "text_hash", "fp", "signatures")
    links = forest(wide_links(docs, own, similarity, shingle, hot_bucket, RADIUS, lambda texts: shingle_hashes(texts, shingle)))
    grouped = components(links)
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("node_rows"))
    of = stored(least.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least", "node_rows"), "nodes")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("key_rows"))
    named = joined_by(of, ids, "component").select("node", "component_id", F.col("node_rows").alias("key_rows"))
    rest = joined_by(nodes.select("doc_id", "n_shingles", "node"), stored(named, "named"), "node").select("doc_id", "n_shingles", "component_id")
    alone = found.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rest.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies of all documents."""
    return near_copies(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT k, list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS g FROM d WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT min(k) AS node, list(k) AS ks, any_value(g) AS g, len(any_value(g)) AS size FROM s GROUP BY list_sort(s.g)),
e AS (SELECT node, size, unnest(g) AS x FROM n),
c AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.b),
m AS (SELECT r.a, min(doc_id) AS component_id FROM r JOIN (SELECT node, unnest(ks) AS k FROM n) x ON x.node = r.b JOIN d ON d.k = x.k GROUP BY r.a)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN (SELECT node, size, unnest(ks) AS k FROM n) x ON x.k = d.k LEFT JOIN m ON m.a = x.node
"""

"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints meet in buckets by parts of their bits: of four 16-bit
parts at least two are equal if two bits differ at most. In a bucket the
fingerprints are stored as bit planes, 64 to a lane word; for each bit the
difference from a query goes into a carry-save counter of 64 distances at
once, and lane words in which all distances exceed the radius are left.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import stored, table, tasks
from emberlog.llm.components import components
from emberlog.llm.textops import by_slice, mix

RADIUS = 2
SHINGLE = 3
#: Buckets with more fingerprints are dealt out again by parts of their other bits.
HOT_BUCKET = 1 << 12
#: Pairs of a query and a lane word that are compared at once.
_PAIRS = 1 << 16
_U = np.uint64
#: From texts to their sets of shingles, as sorted distinct hashes.
Hashed = Callable[[list[bytes]], list[np.ndarray]]


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle, repeats included; fewer words make one, none make none."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if len(words) < shingle:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], dtype="<u8")


def _majority(h: np.ndarray, width: int = 1) -> np.ndarray:
    """width 64-bit words. A bit is 1 if over half of the hashes have it; the first word takes the hashes, the others mixes of them."""
    counts = np.zeros(64 * width, np.int64)
    for k in range(0, len(h), 1 << 13):
        part = h[k : k + (1 << 13), None]
        if width > 1:
            part = np.concatenate([part, mix(part + np.arange(1, width, dtype=_U))], axis=1)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return _majority(_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row of docs; a null text has no words."""
    schema = docs.select("doc_id").schema.add("fp", "long")

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        fps = np.concatenate([fingerprint(t, shingle) for t in texts]).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(by_slice(run), schema)


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def _masks(bits: list[int], radius: int) -> list[int]:
    """Masks of radius + 2 parts taken two at a time; one of them has no difference if radius bits differ at most."""
    return [sum(1 << b for p in pair for b in p) for pair in itertools.combinations(_parts(bits, radius + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Each fingerprint once for each mask, with the mask and the bits under it."""
    return fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )


def compare(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All that compared() gives."""
    found = list(compared(fps, bucket, radius))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def compared(
    fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, asks: np.ndarray | None = None, lane_words: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes (the second is smaller) of fingerprints (n x words) at most radius bits apart that share a bucket; rows of a bucket stand together.

    Only rows of asks are first in a pair, and second are only those of the bucket's first lane_words words of 64.
    """
    n, n_bits = len(fps), 64 * fps.shape[1]
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    words = (size + 63) // 64  # lane words of each bucket
    at_word = np.concatenate([[0], np.cumsum(words)])
    b = np.cumsum(first) - 1
    place = np.arange(n) - start[b]
    word, lane = at_word[b] + place // 64, (place % 64).astype(_U)
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    # planes[k][w]: bit k of the 64 fingerprints of lane word w; full[k][i]: bit k of fingerprint i in all lanes
    planes, full = np.empty((n_bits, len(heads)), _U), np.empty((n_bits, n), _U)
    for k in range(n_bits):
        bit = (fps[:, k // 64] >> _U(k % 64)) & _U(1)
        planes[k] = np.bitwise_or.reduceat(bit << lane, heads)
        full[k] = _U(0) - bit
    taken = np.bitwise_or.reduceat(_U(1) << lane, heads)
    # a query meets the lane words of its bucket up to its own
    per = place // 64 + 1
    if lane_words is not None:
        per = np.minimum(per, lane_words)
    if asks is not None:
        per = per * asks
    ends = np.cumsum(per)
    step = 4 if radius < 8 else 16
    for k in range(0, int(ends[-1]) if n else 0, _PAIRS):
        each = np.arange(k, min(k + _PAIRS, ends[-1]))
        q = np.searchsorted(ends, each, side="right")
        w = each - (ends[q] - per[q]) + at_word[b[q]]
        counters = [np.zeros(len(q), _U) for _ in range(radius.bit_length())]
        over = ~taken[w]
        for bit in range(n_bits):
            carry = planes[bit][w] ^ full[bit][q]
            for c in range(min(len(counters), (bit + 1).bit_length())):  # carry-save: one bit more to 64 vertical counters
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            if bit + 1 >= 1 << len(counters):
                over |= carry
            if bit % step == step - 1 or bit == n_bits - 1:
                above, equal = np.zeros(len(q), _U), np.full(len(q), ~_U(0))  # lanes whose counter exceeds the radius
                for c in reversed(range(len(counters))):
                    if radius >> c & 1:
                        equal &= counters[c]
                    else:
                        above |= equal & counters[c]
                        equal &= ~counters[c]
                over |= above
                go = ~over != 0
                q, w, over, counters = q[go], w[go], over[go], [c[go] for c in counters]
                if not len(q):
                    break
        if len(q):
            near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(near)
            other = heads[w[row]] + bit
            go = other < q[row]
            yield q[row][go], other[go]


def _roots(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first that it is connected with by pairs within buckets."""
    a, b = compare(fps, bucket, radius)
    root = np.arange(len(fps))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def _by_bucket(n_key: int, act: Callable[[np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]]):
    """For mapInArrow over rows whose first n_key columns are their bucket's key, sorted by it: act gets whole buckets, many at a time, as their numbers and all columns."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(h) for h in held]
        new = np.zeros(len(columns[0]), bool)
        for k in columns[:n_key]:
            new[1:] |= k[1:] != k[:-1]
        return act(np.cumsum(new), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if columns[-1].dtype == object:
                size = len(columns[-1][0])
                columns[-1] = np.frombuffer(b"".join(columns[-1]), f"V{size}")
            n = batch.num_rows
            last, goes_on = np.ones(n, bool), bool(held)
            for i, c in enumerate(columns[:n_key]):
                last &= c == c[-1]
                goes_on = goes_on and held[i][-1][-1] == c[0]
            cut = n - int(last.sum())
            if held and not goes_on:
                yield from flush(held)
                held = []
            if held:
                for h, c in zip(held, columns, strict=True):
                    h.append(c[:cut] if cut else c)
                if cut:
                    yield from flush(held)
                    held = [[c[cut:]] for c in columns]
            else:
                if cut:
                    yield from flush([[c[:cut]] for c in columns])
                held = [[c[cut:]] for c in columns]
        if held:
            yield from flush(held)

    return run


def _forest(radius: int):
    """For _by_bucket: the links of a forest of each bucket's fingerprints (the last column)."""

    def act(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp = columns[-1]
        root = _roots(fp.view(_U).reshape(-1, 1), bucket, radius)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    return act


def links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """a, b: links that connect the distinct values of fps.fp as all pairs at most radius bits apart do, no more than a few for each value.

    A bucket shares 2 of radius + 2 parts of the 64 bits. Larger ones than
    hot_bucket are dealt out again by the rest of their bits, after which 48
    of 64 bits are equal: 65,536 fingerprints are the most that such a bucket can hold.
    """
    masks = _masks(list(range(64)), radius)
    fps = fps.select("fp").distinct()
    keyed = _keyed(fps, masks)
    sizes = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    key = ["mask", "key"]
    cold = keyed.join(sizes.where(F.col("n") <= hot_bucket).select(*key), key)
    hot = keyed.join(sizes.where(F.col("n") > hot_bucket).select(*key), key, "left_semi")
    finer: Column = F.create_map(
        *(
            x
            for m in masks
            for x in (
                F.lit(_signed(m)),
                F.array(*(F.lit(_signed(m | f)) for f in _masks([k for k in range(64) if not m >> k & 1], radius))),
            )
        )
    )
    hot = hot.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )
    dealt = (
        cold.select(*key, "fp").unionByName(hot.select(*key, "fp").distinct())
        .repartition(tasks(fps), *key).sortWithinPartitions(*key)
    )
    return dealt.mapInArrow(_by_bucket(2, _forest(radius)), "a long, b long").distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Two rows are linked if their fingerprints differ in radius bits at most;
    component_id is the smallest doc_id reachable. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with a null doc_id
    link others; a component of such rows alone has a null id. Repeated
    rows stay; other columns are ignored, no rows give no rows. A text, however
    long, is read as a whole in one task.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps, radius))
    of = least.join(found, least["fp"] == found["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least"
    )
    of = stored(of, "components")
    # A component may hold a third of all fingerprints: its smallest document is found by partial aggregation.
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = of.join(named, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# Near copies that share most of their words rather than all: parts of the sets of shingles that are equal find candidates, wide fingerprints compare them, the sets decide.

WIDE, WIDE_SHINGLE, SIMILARITY = 4, 5, 0.8
#: Of 256 bits 39 differ on average if two sets share 0.8 of their shingles (48 for sets of 4 and 5); the deviation is 6. So one pair in
#: 10^9 of the smallest sets is beyond WIDE_RADIUS, and fewer of others.
WIDE_RADIUS = 84
#: Words of a bitmap of a set's shingles, from which follows how many of them another set can have at most.
MAP = 32
#: Neighbours that a node is checked against in each round before all pairs of different classes are.
NEAREST = (1, 6)
#: Signatures of a set in a level, and elements of the parts of levels that have more parts than that.
SIGNATURES, PART = 64, 4
#: Pairs of a node that are checked together.
_TOGETHER = 7


def set_name(shingles: np.ndarray) -> int:
    """A set of shingles by the hash of its hashes."""
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), 42))


@functools.cache
def _levels(similarity: float, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each level of sets, its number of parts, and how many filled ones a set must have to leave out its empty ones.

    A level ends so early that a set's partners that are larger are in its
    own level or the next. Sets below the first level have no partner but themselves.
    """
    least = [math.ceil(similarity / (1 - similarity) - 1e-9)]
    least.append(least[0] + 1)
    while least[-1] < most:
        least.append(math.floor((least[-1] - 1) / similarity + 1e-9) + 1)
    parts, need = [], []
    for low, end in itertools.pairwise(least):
        large = math.floor((end - 1) / similarity + 1e-9)  # the largest partner of the level's largest set
        apart = math.floor((1 - similarity) / (1 + similarity) * (end - 1 + large) + 1e-9)
        m = apart + 1
        while m <= SIGNATURES:
            empty = (1 - 1 / m) ** low
            if m * (1 - empty) - 3 * math.sqrt(m * empty * (1 - empty)) >= apart + 1 or m >= low:
                break
            m += 1
        exact = m <= SIGNATURES
        parts.append(m if exact else max(SIGNATURES, low // PART))
        need.append(apart + 1 if exact else 0)
    return np.array(least[:-1]), np.array(parts), np.array(need)


def signatures(sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Number of a set and signature, for sets of distinct hashes: any two different sets with such a similarity share a signature.

    Shingles are dealt to the parts of a level. In small sets (at 0.8, up to
    about 180 shingles) a similar pair differs in fewer elements than the
    level has filled parts, so one of them is equal in both; its hash is the
    signature. Where chance leaves too few filled, the empty ones count as
    well. Of larger sets only the first SIGNATURES parts are looked at; each
    is equal with a probability of 0.28 or more, so a pair shares none
    once in 10^9. Each set has the signatures of its level and, for smaller partners, of the level before.
    """
    least, parts, need = _levels(similarity)
    sizes = np.array([len(x) for x in sets], np.int64)
    hashes, of = np.concatenate([*sets, np.zeros(0, _U)]).astype(_U), np.repeat(np.arange(len(sets)), sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for down in (0, 1):
        level = np.searchsorted(least, sizes, side="right") - 1 - down
        number = np.flatnonzero(level >= 0)
        level = level[number]
        m = np.minimum(parts[level], SIGNATURES)  # those that are looked at
        base = np.zeros(len(sets), np.int64)
        base[number] = np.cumsum(m) - m
        inside = np.zeros(len(sets), bool)
        inside[number] = True
        own = inside[of]
        h, d = hashes[own], of[own]
        own_m = np.zeros(len(sets), np.int64)
        own_m[number] = parts[level]
        part = (((mix(h) >> _U(32)) * own_m[d].astype(_U)) >> _U(32)).astype(np.int64)
        h, d, part = (x[part < SIGNATURES] for x in (h, d, part))
        slot = base[d] + part
        sums, counts = np.zeros(int(m.sum()), _U), np.bincount(slot, minlength=int(m.sum()))
        np.add.at(sums, slot, mix(h ^ _U(0x5DEECE66D)))
        row = np.repeat(np.arange(len(number)), m)
        part = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        filled = np.bincount(row[counts > 0], minlength=len(number))
        kept = (counts > 0) | (filled < need[level])[row]
        place = mix((level[row].astype(_U) << _U(40)) + part.astype(_U))
        found.append((number[row[kept]], mix(sums[kept] ^ place[kept])))
    number, signature = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(number, kind="stable")
    return number[order], signature[order]


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, node (the name of its set of shingles), fp (of the set; binary), signatures."""
    schema = docs.select("doc_id").schema
    for name, kind in (("text_hash", "long"), ("node", "long"), ("fp", "binary")):
        schema = schema.add(name, kind)
    schema = schema.add("signatures", T.ArrayType(T.LongType()))

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = [np.unique(_hashes(t, shingle)) for t in texts]
        number, found = signatures(sets, similarity)
        offsets = np.searchsorted(number, np.arange(len(sets) + 1)).astype(np.int32)
        columns = [
            pa.array([set_name(h) for h in sets], pa.int64()), pa.array([_majority(h, WIDE).tobytes() for h in sets], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64))),
        ]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(by_slice(run), schema)


def _sketch(shingles: np.ndarray) -> bytes:
    bits = np.zeros(64 * MAP, bool)
    bits[(mix(shingles) % _U(64 * MAP)).astype(np.int64)] = True
    return np.array([len(shingles)], _U).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def _may_be_similar(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs can have the similarity. A common shingle is a common bit, or one of those by which a set has fewer bits than shingles; so no similar pair is lost."""
    size, bits = sketches[:, 0].astype(np.int64), sketches[:, 1:]
    spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), _PAIRS):
        x, y = a[k : k + _PAIRS], b[k : k + _PAIRS]
        both = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y])
        out[k : k + _PAIRS] = both >= similarity / (1 + similarity) * (size[x] + size[y]) - 1e-9
    return out


def shingle_sets(docs: DataFrame, rows: DataFrame, shingle: int = WIDE_SHINGLE, hashed: Hashed | None = None) -> DataFrame:
    """node, shingles (distinct hashes), sketch (number and bitmap of them) of the texts of docs that rows names (doc_id, text_hash), one row for each node. hashed: another way from texts to their sets."""

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = hashed(texts) if hashed else [np.unique(_hashes(t, shingle)) for t in texts]
        columns = [pa.array([set_name(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
        columns.append(pa.array([_sketch(h) for h in sets], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    named = rows.select(F.col("doc_id").alias("own_id"), "text_hash")
    same = docs["doc_id"].eqNullSafe(named["own_id"]) & (F.xxhash64(docs["text"]) == named["text_hash"])
    texts = docs.join(named, same, "left_semi").select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(by_slice(run), "node long, shingles array<long>, sketch binary").dropDuplicates(["node"])


def _pairs(node: np.ndarray, bucket: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows as nodes, far bits apart, each side with a part that no more than a few of the node's pairs share."""
    columns = []
    for side in (x, y):
        of = node[side]
        order = np.argsort(of, kind="stable")
        start = np.concatenate([[True], of[order][1:] != of[order][:-1]])[: len(of)]
        rank = np.empty(len(of), np.int64)
        rank[order] = np.arange(len(of)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        columns += [pa.array(of), pa.array((bucket[side] << 32) + (rank >> _TOGETHER))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(far.astype(np.int32))], names=["a", "a_part", "b", "b_part", "far"])


_PAIR = "a long, a_part long, b long, b_part long, far int"


def _nearest(radius: int, most: int):
    """For _by_bucket: for each node the most nearest nodes of other classes among the 64 that come first in its bucket."""

    def act(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        signature, _, node, of, fp = columns
        words = fp.view(_U).reshape(len(fp), -1)
        found = [np.zeros((3, 0), np.int64)]
        for a, b in compared(words, bucket, radius, lane_words=1):
            go = of[a] != of[b]
            a, b = a[go], b[go]
            found.append(np.stack([a, b, np.bitwise_count(words[a] ^ words[b]).sum(1).astype(np.int64)]))
        a, b, far = np.concatenate(found, axis=1)
        order = np.lexsort((b, far, a))
        a, b, far = a[order], b[order], far[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        few = rank < most
        yield _pairs(node, signature, a[few], b[few], far[few])

    return act


def _apart(radius: int, similarity: float):
    """For _by_bucket: the pairs of nodes of different classes that may be similar, of which the one that asks comes second in the bucket; among those that ask, only in buckets of their own."""

    def act(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        signature, _, target, asks, node, of, fp = columns
        asks = asks.astype(bool)
        both = fp.view(_U).reshape(len(fp), -1)
        words, sketches = np.ascontiguousarray(both[:, :WIDE]), both[:, WIDE:]
        for a, b in compared(words, bucket, radius, asks):
            go = (of[a] != of[b]) & (~asks[b] | (target[a] < 0))
            a, b = a[go], b[go]
            go = _may_be_similar(sketches, a, b, similarity)
            a, b = a[go], b[go]
            swap = node[a] < node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield _pairs(node, signature, a, b, np.bitwise_count(words[a] ^ words[b]).sum(1))

    return act


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair of nodes once."""
    parts = F.min(F.struct("a_part", "b_part", "far")).alias("parts")
    return pairs.groupBy("a", "b").agg(parts).select("a", "parts.a_part", "b", "parts.b_part", "parts.far")


def _unsettled(members: DataFrame, wide: DataFrame, classes: DataFrame, hot_bucket: int) -> DataFrame:
    """signature, asker, target, asks, node, class, fp: where a signature's nodes are of several classes, its buckets.

    Nodes of the largest class don't ask, so a large class whose members are
    settled costs no pairs of its own. Nodes that ask and nodes that don't are tiles of
    hot_bucket at most; each tile that asks is a bucket with each that doesn't (target from 0 on) and
    with each that asks (target below 0).
    """
    own = members.join(classes, "node", "left").select("signature", "node", F.coalesce("component", "node").alias("class"))
    sizes = own.groupBy("signature", "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("signature").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("all")).where(F.col("all") > F.col("main.n"))
    tiles = [F.ceil(x / hot_bucket).cast("int").alias(name) for x, name in ((F.col("main.n"), "targets"), (F.col("all") - F.col("main.n"), "askers"))]
    mixed = stored(mixed.select("signature", F.col("main.class").alias("main"), *tiles), "mixed")
    asks = F.col("class") != F.col("main")
    tile = F.pmod(F.xxhash64("node", "signature"), F.when(asks, F.col("askers")).otherwise(F.col("targets"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    bucket = lambda asker, target: F.struct(asker.cast("int").alias("asker"), target.cast("int").alias("target"))
    with_targets = F.transform(upto("targets"), lambda t: bucket(F.col("tile"), t))
    with_askers = F.transform(upto("askers"), lambda k: bucket(F.least("tile", k), -1 - F.greatest("tile", k)))
    buckets = F.when(F.col("asks"), F.concat(with_targets, with_askers)).otherwise(F.transform(upto("askers"), lambda k: bucket(k, F.col("tile"))))
    placed = own.join(mixed, "signature").select("signature", "node", "class", asks.alias("asks"), tile.alias("tile"), "askers", "targets")
    every = placed.select("signature", "node", "class", "asks", F.explode(buckets).alias("bucket"))
    columns = ["signature", "bucket.asker", "bucket.target", F.col("asks").cast("int").alias("asks"), "node", "class", "fp"]
    dealt = every.join(wide, "node").select(*columns).repartition(tasks(members), "signature", "asker", "target")
    return dealt.sortWithinPartitions("signature", "asker", "target", "asks")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs whose sets share so much of their union. A set meets its pairs part by part, so that no task gets all pairs of a node."""
    for side in ("a", "b"):
        key = [side, f"{side}_part"]
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set"))
        pairs = pairs.join(pairs.select(*key).distinct().join(own, side), key)
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.where(both / (F.size("a_set") + F.size("b_set") - both) >= similarity).select("a", "b")


def wide_links(docs: DataFrame, fps: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, hot_bucket: int = HOT_BUCKET, radius: int = WIDE_RADIUS, hashed: Hashed | None = None) -> DataFrame:
    """a, b: pairs of nodes with a similarity of at least similarity that connect all such pairs.

    Candidates share a signature and differ in radius bits at most. In a few
    rounds each node is compared with 64 of each of its buckets, others in
    each, and checked against the nearest of other classes that it finds; the
    links make classes. After that pairs of different classes are checked, all of them.
    """
    every = fps.select("node", F.explode("signatures").alias("signature"))
    shared = every.groupBy("signature").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    members = every.join(stored(shared.select("signature"), "shared"), "signature").select("signature", "node").distinct()
    members = stored(members, "members")
    wide = fps.join(members.select("node").distinct(), "node", "left_semi").select("node", "fp").dropDuplicates(["node"])
    wide = stored(wide, "wide")
    rows = fps.join(wide, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("row.*")
    sets = stored(shingle_sets(docs, rows, shingle, hashed), "shingle-sets")
    hot = members.groupBy("signature").agg(F.ceil(F.count("*") / hot_bucket).cast("int").alias("tiles")).where("tiles > 1")
    hot = stored(hot, "hot-buckets")
    classes, links = wide.select("node", F.col("node").alias("component")).limit(0), []
    for n, most in enumerate(NEAREST):
        place = F.xxhash64("node", "signature", F.lit(n))
        tile = F.pmod(place, F.coalesce("tiles", F.lit(1))).cast("int")
        own = wide.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "fp")
        tiled = members.join(hot, "signature", "left").select("signature", tile.alias("tile"), place.alias("place"), "node")
        dealt = tiled.join(own, "node").repartition(tasks(docs), "signature", "tile").sortWithinPartitions("signature", "tile", "place")
        near = dealt.select("signature", "tile", "node", "class", "fp").mapInArrow(_by_bucket(2, _nearest(radius, most)), _PAIR)
        # of a node's pairs those that differ least
        ranked = F.array_sort(F.collect_list(F.struct("far", "b", "a_part", "b_part")))
        near = _once(near).groupBy("a").agg(F.slice(ranked, 1, most).alias("x")).select("a", F.explode("x").alias("x"))
        near = stored(near.select("a", "x.a_part", "x.b", "x.b_part"), "near")
        links.append(stored(similar(near, sets, similarity), "links"))
        classes = stored(components(reduce(DataFrame.unionByName, links)), "classes")
    both = wide.join(sets, "node").select("node", F.concat("fp", "sketch").alias("fp"))
    apart = stored(_once(_unsettled(members, both, classes, hot_bucket).mapInArrow(_by_bucket(3, _apart(radius, similarity)), _PAIR)), "apart")
    return reduce(DataFrame.unionByName, [*links, stored(similar(apart, sets, similarity), "links")])


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """The rows of docs without near copies: of each component of wide links one row stays, that with the smallest doc_id (null before others; of equal ids by the text's hash, of equal rows any). Texts without words are copies of each other; a text of fewer words than a shingle has one of all its words."""
    fps = stored(wide_fingerprints(docs, shingle, similarity), "wide-fingerprints")
    found = components(wide_links(docs, fps, similarity, shingle, hot_bucket))
    nodes = fps.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = (
        nodes.join(found, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("first"))
        .select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"), F.col("first.n").alias("rows"))
    )
    kept = stored(kept, "kept")

    def of(keys: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(keys["kept_id"]) & (F.xxhash64(docs["text"]) == keys["kept_hash"])
        return docs.join(keys, same, "left_semi")

    return of(kept.where("rows = 1")).unionByName(of(kept.where("rows > 1")).dropDuplicates(["doc_id", "text"]))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. See simhash_components() for odd rows."""
    return simhash_components(table(spark, sf_dir, "documents"))

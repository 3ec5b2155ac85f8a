"""Centroid clustering over bit planes.

Components become integers, and integers bit planes: bit b of all 64
components of a vector is one 64-bit word. The dot product of a vector and a
centroid is the sum of 2^(i+j) times the population count of (plane i of the
one AND plane j of the other), which is exact, and so are squared distances.
Each round is one pass over the stored planes: tasks assign their vectors and
sum them up, and no more than the sums of each cluster leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table

COMPONENTS, SCALE = 64, 256
CLUSTERS, ROUNDS = 40, 5
SEED = "2:"
#: Integers have less than this many bits besides the sign, so that squared distances of 64 components fit 63 bits.
MOST_BITS = 27
#: Vectors that are compared at once, so that their planes stay in a core's cache.
_BLOCK = 4096
_U = np.uint64


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and e (array<long>: floor(256 * x)) of the vectors with exactly 64 components, all finite and none null.

    Vectors with a component from 2^19 on (in magnitude) have squared distances beyond 64 bits and are left out as well.
    """
    x = F.col(column).cast("array<double>")
    good = F.forall(x, lambda c: F.coalesce(F.abs(c) < 2.0**MOST_BITS / SCALE, F.lit(False)) & ~F.isnan(c))
    fits = F.coalesce((F.size(x) == COMPONENTS) & good, F.lit(False))
    return vectors.where(fits).select(F.col(id_column).alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("e"))


def to_planes(values: np.ndarray, width: int) -> np.ndarray:
    """width x n words of n vectors (n x 64) of integers from 0 to 2^width - 1."""
    bits = (values[None, :, :] >> np.arange(width)[:, None, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0].astype(_U)


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The integers (n x 64) of planes (width x n)."""
    out = np.zeros((planes.shape[1], COMPONENTS), np.int64)
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out += bits.astype(np.int64) << k
    return out


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products of n vectors with one, each of whose planes is a word or an array of n words. Counts of one weight are added up before they are shifted."""
    out = np.zeros(planes.shape[1], np.int64)
    for s in range(len(planes) + len(other) - 2, -1, -1):
        counts = np.zeros(planes.shape[1], np.uint16)
        for i in range(max(0, s - len(other) + 1), min(len(planes), s + 1)):
            counts += np.bitwise_count(planes[i] & other[s - i])
        out = (out << 1) + counts
    return out


class Centres:
    """Centroids as bit planes, for vectors whose planes are of v - low."""

    def __init__(self, centres: np.ndarray, low: int):
        self.low, self.own = low, int(centres.min())
        shifted = centres - self.own
        self.planes = to_planes(shifted, max(1, int(shifted.max()).bit_length()))
        self.sums, self.squares = shifted.sum(1), (centres * centres).sum(1)

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (of equally near ones the smallest) and squared distance of each vector. Sums may pass 64 bits on the way, the distances don't."""
        n = planes.shape[1]
        total = np.zeros(n, np.int64)
        for k, plane in enumerate(planes):
            total += np.bitwise_count(plane).astype(np.int64) << k
        own = dots(planes, planes) + 2 * self.low * total + COMPONENTS * self.low * self.low
        best, least = np.zeros(n, np.int32), np.full(n, np.iinfo(np.int64).max)
        for c in range(self.planes.shape[1]):
            inner = dots(planes, self.planes[:, c]) + self.own * total + self.low * int(self.sums[c]) + COMPONENTS * self.low * self.own
            far = own - 2 * inner + int(self.squares[c])
            closer = far < least
            best[closer], least[closer] = c, far[closer]
        return best, least


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Offset and planes of the batch's vectors, a block at a time."""
    words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, width).astype(_U)
    for k in range(0, len(words), _BLOCK):
        yield k, np.ascontiguousarray(words[k : k + _BLOCK].T)


def packed(numbers: DataFrame, low: int, width: int) -> DataFrame:
    """id, planes (width words of 8 bytes) of quantised vectors, of e - low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, COMPONENTS)
            words = np.ascontiguousarray(to_planes(values - low, width).T).astype("<u8")
            planes = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), planes], names=["id", "planes"])

    return numbers.mapInArrow(run, numbers.select("id").schema.add("planes", "binary"))


def _sums(planes: DataFrame, centres: np.ndarray, low: int, width: int) -> list:
    """cluster, component, n and sum of each cluster's vectors: as many rows as centroids have components. A task sends one row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centres(centres, low)
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            for _, block in _blocks(batch, width):
                best, _ = own.nearest(block)
                order = np.argsort(best, kind="stable")
                some, first = np.unique(best[order], return_index=True)
                sums[some] += np.add.reduceat(from_planes(block)[order] + low, first, axis=0)
                counts += np.bincount(best, minlength=len(centres))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    rows = planes.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("component", "x"))
    return rows.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()


def _assigned(planes: DataFrame, centres: np.ndarray, low: int, width: int) -> DataFrame:
    """id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centres(centres, low)
        for batch in batches:
            for k, block in _blocks(batch, width):
                best, far = own.nearest(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, len(best)), pa.array(best), pa.array(far)], names=["id", "cluster", "distance"])

    return planes.mapInArrow(run, planes.select("id").schema.add("cluster", "integer").add("distance", "long"))


def _sha(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that quantised() keeps.

    The first centroids are the most vectors (or all, if there are fewer) with
    the smallest SHA-256 of seed and id; equal hashes (repeated ids) go by
    their components, null ids come last. In each round vectors go to their
    nearest centroid, ties to the smaller number, and centroids move to the
    floors of their vectors' means; one without vectors stays. Repeated rows
    count each, other columns are ignored, no vectors give no rows. What the
    driver sees are centroids and sums over clusters, never vectors.
    """
    spark = vectors.sparkSession
    numbers = quantised(vectors, id_column, column)
    kind = numbers.select(F.col("id").alias(id_column)).schema
    for name, t in (("cluster", "integer"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")):
        kind = kind.add(name, t)
    low, high = numbers.agg(F.min(F.array_min("e")), F.max(F.array_max("e"))).first()
    if low is None:
        return spark.createDataFrame([], kind)
    width = max(1, (high - low).bit_length())
    planes = stored(packed(numbers, low, width), "bit-planes")
    rank = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = planes.select("planes", rank.alias("rank")).orderBy(F.asc_nulls_last("rank"), "planes").limit(most).collect()
    centres = from_planes(np.array([np.frombuffer(r["planes"], "<u8") for r in first]).T.astype(_U)) + low
    for _ in range(rounds):
        for r in _sums(planes, centres, low, width):
            centres[r["cluster"], r["component"]] = int(r["x"]) // r["n"]
    found = stored(_assigned(planes, centres, low, width), "assigned")
    sums = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    facts = spark.createDataFrame([(c, x, _sha(centres[c])) for c, x in sums.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(facts), "cluster")  # a row for each centroid
    return joined.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of embeddings."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """SQL of assignment k and of the centroids that follow from it."""
    return f"""
a{k} AS MATERIALIZED (SELECT v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.v, c{k}.c, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c{k}.x) + list_inner_product(c{k}.x, c{k}.x))::BIGINT AS d
  FROM v, c{k}) GROUP BY v),
m{k} AS (SELECT c, i, sum(y::HUGEINT) AS s, count(*) AS n FROM (SELECT a{k}.c, unnest(v.x) AS y, unnest(range(1, 65)) AS i FROM a{k} JOIN v ON v.v = a{k}.v) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM m{k} GROUP BY c) m ON m.c = c{k}.c)"""


SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {COMPONENTS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('{SEED}' || vec_id) AS h FROM v ORDER BY h LIMIT {CLUSTERS})),
{",".join(_round(k) for k in range(ROUNDS + 1))},
s AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, a.d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM s)::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.v = a.v JOIN s ON s.c = a.c JOIN c{ROUNDS} c ON c.c = a.c
"""

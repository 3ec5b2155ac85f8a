"""Error groups: fingerprint dedup, density clusters and their summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions import vectors as V
from emberlog.operators import cells
from emberlog.operators.graph import components
from emberlog.sources import commits
from emberlog.sources.shared import stored

ERROR_SEVERITIES = ["ERROR", "CRITICAL", "FATAL"]
MIN_SAMPLES, EPS = 2, 0.25
#: Vectors of a tile of dbscan(), which keeps no list of near pairs and so can take larger ones than others: each vector is sent to as many tasks as its key has tiles.
TILE = 8192


def errors(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("severity").isin(ERROR_SEVERITIES))


def within(logs: DataFrame, as_of: Column, interval: str, column: str = "timestamp") -> DataFrame:
    """Rows from the interval up to as_of (both ends belong to it)."""
    return logs.where((F.col(column) >= as_of - F.expr(f"INTERVAL {interval}")) & (F.col(column) <= as_of))


def dedup_groups(logs: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each service and fingerprint of errors: count, first and last time, latest message and severity; with_ids: also all ids (ascending) as source_record_ids.

    All aggregates combine before the shuffle, so a frequent fingerprint costs
    a row of each task. Ids of a group stand in one row; for groups of any
    size there are dedup_members() and member_bitmaps() instead.
    """
    by_time = F.struct("timestamp", "id")
    ids = [F.array_sort(F.collect_set("id")).alias("source_record_ids")] if with_ids else []
    return (
        errors(logs).withColumn("fingerprint", T.fingerprint(F.col("message")))
        .groupBy("service_name", "fingerprint")
        .agg(
            F.count("*").alias("occurrence_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
            F.max_by("message", by_time).alias("canonical_message"), F.max_by("severity", by_time).alias("severity"), *ids,
        )
    )


def dedup_members(logs: DataFrame) -> DataFrame:
    """service_name, fingerprint, id of every error: the members of dedup_groups, a row each, for groups of any size."""
    return errors(logs).select("service_name", T.fingerprint(F.col("message")).alias("fingerprint"), "id")


BITMAPS = "members"
_BITMAPS = "service_name string, fingerprint string, bucket long, ids binary, first_seen timestamp_ntz, last_seen timestamp_ntz"


def member_bitmaps(logs: DataFrame) -> DataFrame:
    """service_name, fingerprint, bucket, ids, first_seen, last_seen: the members of each group as bitmaps of 4 KB, one for each range of 32,768 ids (long) that it has members in. Errors without an id are left out."""
    own = errors(logs).where("id is not null").select("service_name", T.fingerprint(F.col("message")).alias("fingerprint"), "id", "timestamp")
    return own.groupBy("service_name", "fingerprint", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("ids"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Any number of member_bitmaps() as one: bitmaps of a group and range are united, so a record that several have is a member once."""
    return bitmaps.groupBy("service_name", "fingerprint", "bucket").agg(
        F.bitmap_or_agg("ids").alias("ids"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def bitmap_groups(bitmaps: DataFrame) -> DataFrame:
    """service_name, fingerprint, occurrence_count, first_seen, last_seen of merged bitmaps; no row grows with its group."""
    return bitmaps.groupBy("service_name", "fingerprint").agg(
        F.sum(F.bitmap_count("ids")).alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def count_batch(logs: DataFrame, path: str, batch: str) -> DataFrame:
    """Adds a batch's members to those kept under path and returns all groups. A batch or a record that is delivered again, in whatever batch, changes nothing."""
    spark = logs.sparkSession
    if commits.find(spark, path, batch) is None:
        attempt = commits.new_attempt()
        member_bitmaps(logs).write.parquet(commits.folder(path, BITMAPS, attempt))
        commits.publish(spark, path, batch, attempt, [BITMAPS])
    return bitmap_groups(merged_bitmaps(commits.read(spark, path, BITMAPS, spark.createDataFrame([], _BITMAPS).schema)))


def dedup_pass(logs: DataFrame, known: DataFrame, as_of: Column, minutes: int = 60, newest: int = 1000) -> DataFrame:
    """Of the newest errors of the look-back of each service: processed records, new groups and those merged into known ones (service_name, fingerprint)."""
    recent = within(errors(logs), as_of, f"{minutes} MINUTES")
    ranked = recent.withColumn("_n", F.expr("row_number() over (partition by service_name order by timestamp desc, id desc)"))
    groups = (
        ranked.where(F.col("_n") <= newest).withColumn("fingerprint", T.fingerprint(F.col("message")))
        .groupBy("service_name", "fingerprint").agg(F.count("*").alias("n"))
    )
    seen = known.select("service_name", "fingerprint", F.lit(True).alias("known"))
    return groups.join(seen, ["service_name", "fingerprint"], "left").groupBy("service_name").agg(
        F.sum("n").alias("processed"),
        F.count_if(F.col("known").isNull()).alias("new_groups"),
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(F.col("n") - 1)).alias("merged"),
    )


def _angle(eps: float) -> float:
    """The angle of vectors whose cosine distance is eps."""
    return math.acos(min(max(1 - eps, -1.0), 1.0))


def _near(own: pa.Table, every: pa.Table, eps: float, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in own and every of pairs of different ids within eps, some rows of own at a time."""
    if not (len(own) and len(every)):
        return
    a, b = cells.matrix(own.column("v")), cells.matrix(every.column("v"))
    ids, others = own.column("id").to_numpy(), every.column("id").to_numpy()
    for k in range(0, len(a), rows):
        i, j = np.nonzero(1 - a[k : k + rows] @ b.T <= eps)
        some = ids[i + k] != others[j]
        yield i[some] + k, j[some]


def pairs_within(vectors: DataFrame, key: str, eps: float, tile: int = cells.TILE, pivots: int = cells.PIVOTS) -> DataFrame:
    """src, dst (both ways) of vectors with the same key whose cosine distance is eps at most; vectors of no length have none.

    Vectors meet in cells of the unit sphere that can hold a neighbour, and
    there by tiles: a matrix product in numpy, of which only near pairs are
    written. So no key or cell, however frequent, meets in one task.
    """
    kind = vectors.schema["id"].dataType

    def near(own: pa.Table, every: pa.Table) -> pa.Table:
        found = [(own.column("id").take(pa.array(i)), every.column("id").take(pa.array(j))) for i, j in _near(own, every, eps)]
        none = own.column("id").slice(0, 0)
        return pa.table({"src": pa.chunked_array([c for x, _ in found for c in x.chunks], none.type), "dst": pa.chunked_array([c for _, y in found for c in y.chunks], none.type)})

    return cells.meet(cells.placed(cells.split(vectors, key, tile, pivots), _angle(eps)), near, f"src {kind.simpleString()}, dst {kind.simpleString()}", tile)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest that links (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def dbscan(vectors: DataFrame, key: str = "service_id", eps: float = EPS, min_samples: int = MIN_SAMPLES, tile: int = TILE, pivots: int = cells.PIVOTS) -> DataFrame:
    """key, id, label of every vector (id, key, embedding): density clusters by cosine distance within each key.

    A core has min_samples other vectors within eps. Clusters are the
    components of cores, numbered from 0 by their smallest core id; a vector
    near a core takes the lowest label of those; the rest is noise, -1.

    Equal vectors of a key are one, with a weight. Cells meet twice: first
    their vectors' neighbours are counted, then, as cores are known, a task
    sends a forest of its cores and, for each other vector, one core of each
    tree that it is near to. No list of near pairs is ever made, so dense clusters cost no more rows than others;
    within a task the forest takes up the pairs of some rows at a time.
    """
    id_type = vectors.schema["id"].dataType.simpleString()
    own = vectors.select(F.col(key).alias("key"), "id", V.doubles(F.col("embedding")).alias("embedding"))
    same = own.where("key is not null and embedding is not null").groupBy("key", "embedding").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    same = stored(same, "distinct-vectors")
    split = cells.split(same.select("key", F.col("first").alias("id"), "embedding"), "key", tile, pivots)
    weighted = split.rows.join(same.select(F.col("first").alias("id"), "weight"), "id")
    inside = stored(cells.placed(cells.Cells(weighted, split.pivots), _angle(eps)), "placed")

    def count(own: pa.Table, every: pa.Table) -> pa.Table:
        n, weight = np.zeros(len(own), np.int64), every.column("weight").to_numpy()
        for i, j in _near(own, every, eps):
            np.add.at(n, i, weight[j])
        return pa.table({"id": own.column("id"), "n": pa.array(n)})

    counts = cells.meet(inside, count, f"id {id_type}, n long", tile).groupBy("id").agg(F.sum("n").alias("n"))
    # equal vectors are neighbours of each other unless eps is negative or they have no length, and then they have no cell
    cores = same.join(counts.withColumnRenamed("id", "first"), "first").where(F.col("n") + F.col("weight") - 1 >= min_samples).select(F.col("first").alias("id"))
    cores = stored(cores, "cores")
    marked = inside.join(cores.withColumn("core", F.lit(True)), "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))

    def grow(own: pa.Table, every: pa.Table) -> pa.Table:
        """src, dst: links of cores' trees, and of each other vector with one core of each tree near it."""
        every = every.filter(every.column("core"))
        ids = pa.chunked_array([*own.column("id").chunks, *every.column("id").chunks], own.schema.field("id").type)
        core, n = own.column("core").to_numpy(), len(own)
        names = ids.to_numpy()
        _, same_id = np.unique(names, return_inverse=True)  # a core of the cell stands in both tables
        root, edges = np.arange(len(names)), [np.zeros((2, 0), np.int64)]
        for i, j in _near(own, every, eps):
            a, b, inner = same_id[i], same_id[j + n], core[i]
            tree = np.flatnonzero(root != np.arange(len(root)))
            root = _roots(len(root), np.concatenate([tree, a[inner]]), np.concatenate([root[tree], b[inner]]))
            edges.append(np.unique(np.stack([a[~inner], root[b[~inner]]]), axis=1))
        of = np.zeros(len(names), np.int64)
        of[same_id] = np.arange(len(names))
        tree = np.flatnonzero(root != np.arange(len(root)))
        edge = np.concatenate(edges, axis=1)
        edge = np.unique(np.stack([edge[0], root[edge[1]]]), axis=1)
        src, dst = np.concatenate([of[tree], of[edge[0]]]), np.concatenate([of[root[tree]], of[edge[1]]])
        links = np.repeat([True, False], [len(tree), edge.shape[1]])
        return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "cores": pa.array(links)})

    grown = stored(cells.meet(marked, grow, f"src {id_type}, dst {id_type}, cores boolean", tile), "grown")
    found = components(grown.where("cores").select("src", "dst"))
    roots = cores.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    named = roots.join(same.select(F.col("first").alias("id"), "key"), "id")
    numbers = named.select("key", "root").distinct().withColumn("label", F.expr("row_number() over (partition by key order by root) - 1"))
    named = stored(named.join(numbers, ["key", "root"]).select("id", "label"), "labels")
    border = (
        grown.where("not cores").join(named.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("border"))
        .select(F.col("src").alias("id"), "border")
    )
    labels = same.join(named.withColumnRenamed("id", "first"), "first", "left").join(border.withColumnRenamed("id", "first"), "first", "left")
    labels = labels.select("key", "embedding", F.coalesce("label", "border", F.lit(-1)).cast("int").alias("label"))
    return own.join(labels, ["key", "embedding"], "left").select(F.col("key").alias(key), "id", F.coalesce("label", F.lit(-1)).alias("label"))


def auto_label(message: Column) -> Column:
    """The label of a cluster without a model: its first message, cut at 60 characters."""
    return T.cut(message, 60, "...")


def cluster_summary(members: DataFrame, key: str = "service_id") -> DataFrame:
    """key, label, member_count, centroid (6 digits), confidence (mean similarity to it, 4 digits) of members (key, id, label, embedding); noise is left out."""
    own = members.where("label >= 0")
    centre = V.centroids(own, [key, "label"], "embedding")
    return (
        own.join(centre, [key, "label"]).groupBy(key, "label")
        .agg(F.count("*").alias("member_count"), F.round(F.avg(V.cosine(F.col("embedding"), F.col("centroid"))), 4).alias("confidence_score"))
        .join(centre, [key, "label"])
    )


def cluster_pass_summary(labels: DataFrame, clusters: DataFrame, key: str = "service_id") -> DataFrame:
    """Per key: vectors processed, clusters, noise, mean silhouette (4 digits, 0 without clusters)."""
    counts = labels.groupBy(key).agg(F.count("*").alias("processed"), F.count_if(F.col("label") < 0).alias("noise"))
    good = clusters.groupBy(key).agg(F.count("*").alias("clusters"), F.avg("confidence_score").alias("s"))
    return counts.join(good, key, "left").select(
        key, "processed", F.coalesce("clusters", F.lit(0)).alias("clusters"), "noise", F.round(F.coalesce("s", F.lit(0.0)), 4).alias("silhouette")
    )


def merge_clusters(existing: DataFrame, new: DataFrame, key: str = "service_id") -> DataFrame:
    """existing (key, label, member_count, is_active) after a pass: new values where the label came again, inactive where it didn't, and new labels."""
    e, n = existing.alias("e"), new.alias("n")
    same = (F.col(f"e.{key}") == F.col(f"n.{key}")) & (F.col("e.label") == F.col("n.label"))
    return e.join(n, same, "full_outer").select(
        F.coalesce(f"n.{key}", f"e.{key}").alias(key),
        F.coalesce("n.label", "e.label").alias("label"),
        F.coalesce("n.member_count", "e.member_count").alias("member_count"),
        F.col("n.label").isNotNull().alias("is_active"),
    )

"""Vectors in cells of the unit sphere, so that only cells that can hold a neighbour meet.

Some vectors of a large key are pivots; a vector belongs to the cell of its
nearest pivot. Angles obey the triangle inequality, which says which cells can
hold a vector within a given angle (for pairs), and how similar the best vector
of a cell can be at most (for nearest neighbours). Both are exact: what isn't
looked at can't be a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions import vectors as V
from emberlog.sources.shared import stored

#: Vectors of a tile; two tiles meet in a task. Pivots of all keys together, whose vectors every task gets, and of how many vectors each is chosen.
TILE, PIVOTS, CHOICE = 2048, 1024, 4
#: Angles from cosines are wrong by less than this.
SLACK = 1e-7
CELL = ["key", "dims", "cell"]


class Cells(NamedTuple):
    """rows: key, dims, id, v (unit length), cell, angle (to the pivot). pivots: for keys with several cells, their pivots (cells x dims) and the largest angle of each."""

    rows: DataFrame
    pivots: dict[tuple, tuple[np.ndarray, np.ndarray]]


def lists(values: np.ndarray) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1))[: n + 1], pa.int32()), pa.array(values.ravel()))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def by_key(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, dims) and the places of its rows, for each in a batch whose first two columns they are."""
    places: dict[tuple, list[int]] = {}
    for k, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        places.setdefault(pair, []).append(k)
    for pair, at in places.items():
        yield pair, np.array(at)


def spread(sample: np.ndarray, m: int) -> np.ndarray:
    """m of the vectors of a sample (fewer if there aren't as many different ones), each as far from those before as any: groups of vectors get a pivot each."""
    some, near = [0], sample @ sample[0]
    while len(some) < m and near.min() < 1 - SLACK:
        some.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[some[-1]])
    return sample[some]


def split(vectors: DataFrame, key: str, tile: int = TILE, most: int = PIVOTS) -> Cells:
    """Cells of vectors (id, key, embedding). Vectors that are null, of no length or without a key have no cell; vectors of different dimensions share none.

    A key with more vectors than tile gets pivots in proportion to its share of
    all vectors, spread over a few times as many, one from each bucket of ids; the others are one cell each.
    """
    own = vectors.select(F.col(key).alias("key"), F.size("embedding").alias("dims"), "id", V.doubles(F.col("embedding")).alias("v")).where("key is not null and v is not null and dims > 0")
    sizes = own.groupBy("key", "dims").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.where((F.col("n") > tile) & (F.col("n") * most >= 2 * total)).withColumn("m", F.least(F.floor(F.col("n") * most / total), F.ceil(F.col("n") / tile)))
    bucket = F.pmod(F.xxhash64("id"), CHOICE * F.col("m"))
    chosen = own.join(F.broadcast(large.select("key", "dims", "m")), ["key", "dims"]).groupBy("key", "dims", bucket.alias("bucket")).agg(F.min_by("v", F.xxhash64("id", "v")).alias("v"))
    found: dict[tuple, list] = {}
    for r in chosen.collect():  # CHOICE * most at most
        if any(r["v"]):
            found.setdefault((r["key"], r["dims"]), []).append(np.array(r["v"]) / np.linalg.norm(r["v"]))
    pivots = {k: spread(np.array(p), -(-len(p) // CHOICE)) for k, p in found.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, at in by_key(batch):
                part = batch.take(pa.array(at))
                v = matrix(part.column(3)).astype(float)
                size = np.sqrt((v * v).sum(axis=1))
                some = np.flatnonzero(size > 0)
                unit = v[some] / size[some, None]
                if (p := pivots.get(pair)) is None:
                    cell, angle = np.zeros(len(some), np.int32), np.full(len(some), math.pi)
                else:
                    near = unit @ p.T
                    cell = near.argmax(axis=1).astype(np.int32)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                part = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(unit), pa.array(cell), pa.array(angle)], names=[*part.schema.names[:3], "v", "cell", "angle"])

    schema = own.select("*").schema.add("cell", "integer").add("angle", "double")
    rows = stored(own.mapInArrow(assign, schema), "cells")
    radii = {k: np.zeros(len(p)) for k, p in pivots.items()}
    if pivots:
        hot = rows.join(F.broadcast(large.select("key", "dims")), ["key", "dims"])
        for r in hot.groupBy(*CELL).agg(F.max("angle").alias("r")).collect():  # a row for each pivot
            if (r["key"], r["dims"]) in radii:
                radii[r["key"], r["dims"]][r["cell"]] = r["r"]
    return Cells(rows, {k: (p, radii[k]) for k, p in pivots.items()})


def placed(cells: Cells, angle: float) -> DataFrame:
    """key, dims, cell, owned, id, v: each vector in its own cell, and in all others that can hold one within angle of it.

    Such a cell's radius and the angle reach its pivot, and the vector is
    within angle of the half-space that is nearer to that pivot than to its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, at in by_key(batch):
                part = batch.take(pa.array(at))
                cell, n = part.column(4).to_numpy(), len(at)
                row, to = np.arange(n), cell
                if pair in pivots:
                    p, radius = pivots[pair]
                    near = matrix(part.column(3)) @ p.T
                    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                    reach = np.arccos(np.clip(near, -1, 1)) <= radius + angle + SLACK
                    if angle < math.pi / 2:
                        reach &= near[row, cell][:, None] - near <= math.sin(angle) * apart[cell] + SLACK
                    reach[row, cell] = True
                    row, to = np.nonzero(reach)
                part, owned = part.take(pa.array(row)), cell[row] == to
                columns = [part.column(0), part.column(1), pa.array(to.astype(np.int32)), pa.array(owned), part.column(2), part.column(3), *part.columns[6:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own, pivots = cells
    extra = [f for f in own.schema.fields if f.name not in ("key", "dims", "id", "v", "cell", "angle")]
    names = ["key", "dims", "cell", "owned", "id", "v", *(f.name for f in extra)]
    schema = own.select("key", "dims", "cell").schema.add("owned", "boolean").add(own.schema["id"]).add(own.schema["v"])
    for f in extra:
        schema = schema.add(f)
    return own.select("key", "dims", "id", "v", "cell", "angle", *(f.name for f in extra)).mapInArrow(run, schema)


def candidates(inside: DataFrame) -> int:
    """Pairs that placed() lets meet: of each cell its own vectors times all that were sent to it, less each with itself."""
    sizes = inside.groupBy(*CELL).agg(F.count_if("owned").alias("own"), F.count("*").alias("all"))
    return int(sizes.agg(F.sum(F.col("own") * (F.col("all") - 1))).first()[0] or 0)


def meet(inside: DataFrame, act: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile: int = TILE, among: bool = True) -> DataFrame:
    """act(own, all) over tiles of each cell: each owned vector of a cell meets all vectors in it (not among: only those not owned), by tiles of a bounded size, so no cell is too large for a task."""
    column = F.lit(True) if among else ~F.col("owned")
    sizes = inside.groupBy(*CELL).agg(F.ceil(F.count_if("owned") / tile).cast("int").alias("rows"), F.ceil(F.count_if(column) / tile).cast("int").alias("columns"))
    sizes = stored(sizes.where("rows > 0 and columns > 0"), "tiles")
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<i:int,j:int,side:boolean>>")
    as_row = F.when(F.col("owned"), F.transform(upto("columns"), lambda j: place(of("rows"), j, True))).otherwise(none)
    as_column = F.when(column, F.transform(upto("rows"), lambda i: place(i, of("columns"), False))).otherwise(none)
    dealt = inside.join(sizes, CELL).withColumn("_at", F.explode(F.concat(as_row, as_column))).drop("rows", "columns")

    def block(t: pa.Table) -> pa.Table:
        side = t.column("side")
        return act(t.filter(side), t.filter(pa.compute.invert(side)))

    return dealt.select("*", "_at.*").drop("_at").groupBy(*CELL, "i", "j").applyInArrow(block, schema)


def bounds(cells: Cells, queries: DataFrame, least: float) -> DataFrame:
    """key, dims, id, v, cell, bound, nth for each cell of a query's key (queries: key, dims, id, v of unit length) that may hold a vector at least so similar.

    bound: no vector of the cell is more similar, as it is within the cell's radius of the pivot; nth: the cell's place among those of the query, the best bound first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, at in by_key(batch):
                part, n = batch.take(pa.array(at)), len(at)
                if pair in pivots:
                    p, radius = pivots[pair]
                    angle = np.arccos(np.clip(matrix(part.column(3)) @ p.T, -1, 1))
                    bound = np.cos(np.clip(angle - radius - SLACK, 0, math.pi))
                    order = np.lexsort((angle, -bound), axis=1)
                else:
                    bound, order = np.ones((n, 1)), np.zeros((n, 1), np.int64)
                row, nth = np.divmod(np.arange(order.size), order.shape[1])
                cell = order.ravel()
                go = bound[row, cell] >= least - SLACK
                row, nth, cell = row[go], nth[go], cell[go]
                columns = [*part.take(pa.array(row)).columns, pa.array(cell.astype(np.int32)), pa.array(bound[row, cell]), pa.array(nth.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    pivots = cells.pivots
    names = ["key", "dims", "id", "v", "cell", "bound", "nth"]
    own = queries.select(*names[:4])
    return own.mapInArrow(run, own.select("*").schema.add("cell", "integer").add("bound", "double").add("nth", "integer"))


def unit_length(vectors: DataFrame, key: str) -> DataFrame:
    """key, dims, id, v of unit length of vectors (id, key, embedding) that have a length."""
    v = V.doubles(F.col("embedding"))
    own = vectors.select(F.col(key).alias("key"), F.size("embedding").alias("dims"), "id", v.alias("v"), V.norm(v).alias("size"))
    return own.where("key is not null and size > 0").select("key", "dims", "id", F.transform("v", lambda x: x / F.col("size")).alias("v"))


def nearest(cells: Cells, queries: DataFrame, k: int, least: float, tile: int = TILE) -> tuple[DataFrame, list[DataFrame]]:
    """query_id, id, similarity: the k most similar vectors of each query (as bounds() takes them), itself not among them, at least so similar (least above 0); equally similar ones by id. And the cells that were opened in each round.

    Branch and bound: the first round opens a query's best cell, which gives
    a k-th similarity; the second opens those others alone whose bound reaches it.
    """
    if least <= 0:
        raise ValueError("the least similarity must be above 0, as vectors without length have none")
    asked = stored(bounds(cells, queries, least), "bounds")
    vectors = cells.rows.select(*CELL, F.lit(False).alias("owned"), "id", "v")
    id_type = queries.schema["id"].dataType.simpleString()

    def best(own: pa.Table, every: pa.Table) -> pa.Table:
        a, b = matrix(own.column("v")), matrix(every.column("v"))
        ids, others = own.column("id"), every.column("id")
        names, rest = ids.to_numpy(), others.to_numpy()
        order = np.empty(len(rest), np.int64)
        order[np.argsort(rest, kind="stable")] = np.arange(len(rest))
        found = [np.zeros((3, 0))]
        for at in range(0, len(a), 256):
            near = np.round(a[at : at + 256] @ b.T, 12)  # equal vectors are equally similar wherever they stand
            near[names[at : at + 256, None] == rest] = -2
            kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
            i, j = np.nonzero((near >= kth[:, None]) & (near >= least))
            s = near[i, j]
            by = np.lexsort((order[j], -s, i))
            i, j, s = i[by], j[by], s[by]
            few = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append(np.stack([i[few] + at, j[few], s[few]]))
        i, j, s = np.concatenate(found, axis=1)
        return pa.table({"query_id": ids.take(pa.array(i.astype(np.int64))), "id": others.take(pa.array(j.astype(np.int64))), "similarity": pa.array(s)})

    def open_(some: DataFrame) -> DataFrame:
        inside = some.select(*CELL, F.lit(True).alias("owned"), "id", "v").unionByName(vectors)
        return stored(meet(inside, best, f"query_id {id_type}, id {id_type}, similarity double", tile, among=False), "nearest")

    def ranked(found: DataFrame) -> DataFrame:
        n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("n", n).where(F.col("n") <= k)

    first = asked.where("nth = 0")
    one = ranked(open_(first))
    reached = one.where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("kth"))
    second = stored(asked.where("nth > 0").join(reached, "id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)), "opened")
    return ranked(one.drop("n").unionByName(open_(second))).drop("n"), [first, second]

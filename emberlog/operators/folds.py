"""Folds in order without lists: steps are functions that compose, so stretches of them are reduced apart.

A fold over a key's rows in order is a composition of one function for each
row. If functions of a kind compose to one of the same kind, of a fixed size,
then each task can reduce what it has of a key to one function, whatever its number of rows. Rows are
range-partitioned by key and order, so a key with most of all rows is cut
over many tasks; what they leave, a row for each task and key at most, is composed in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Composes functions, given as rows of parameters: first the one, then the other.
Compose = Callable[[np.ndarray, np.ndarray], np.ndarray]


def clamps(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Functions x -> min(max(x + d, low), high), as rows (d, low, high)."""
    d, low, high = then.T
    return np.stack([first[:, 0] + d, np.clip(first[:, 1] + d, low, high), np.clip(first[:, 2] + d, low, high)], axis=1)


def transitions(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Moves between n states, as rows of the n states that each becomes and the n numbers of refused moves on the way."""
    n = first.shape[1] // 2
    to = first[:, :n].astype(np.int64)
    return np.concatenate([np.take_along_axis(then[:, :n], to, 1), first[:, n:] + np.take_along_axis(then[:, n:], to, 1)], axis=1)


def reduced(steps: np.ndarray, start: np.ndarray, compose: Compose) -> np.ndarray:
    """The composition of each stretch of steps; start: where stretches begin. Neighbours are composed in halving rounds."""
    of = np.zeros(len(steps), np.int64)
    of[start[1:]] = 1
    of = np.cumsum(of)
    while len(steps) > len(start):
        place = np.arange(len(of)) - np.searchsorted(of, of)
        left = np.flatnonzero(place % 2 == 0)
        pair = np.append(of[1:] == of[:-1], False)[left]
        out = steps[left]
        out[pair] = compose(steps[left[pair]], steps[left[pair] + 1])
        steps, of = out, of[left]
    return steps


def fold(rows: DataFrame, keys: list[str], order: list[str], compose: Compose, step: str = "step") -> DataFrame:
    """keys, step: the composition of each key's steps (array<double>, none null, all of one length) in order; equal places are ordered by their steps."""
    names = [*keys, *order, step]
    own = rows.select(*names)
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(tasks, *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks().to_batches()[0]
            key = list(zip(*(both.column(k).to_pylist() for k in range(len(keys))), strict=True))
            start = np.array([0, *(k for k in range(1, len(key)) if key[k] != key[k - 1])])
            steps = both.column(len(names) - 1).flatten().to_numpy().reshape(len(key), -1)
            found = reduced(steps, start, compose)
            columns = [*(c.take(pa.array(start)) for c in both.columns[:-1]), pa.array(list(found), both.schema.field(step).type)]
            done = pa.RecordBatch.from_arrays(columns, schema=both.schema)
            yield done.slice(0, len(start) - 1)
            held = done.slice(len(start) - 1)
        if held is not None:
            yield held

    def finish(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by([(c, "ascending") for c in [*order, "part"]])
        steps = parts.column(step).combine_chunks().flatten().to_numpy().reshape(len(parts), -1)
        whole = reduced(steps, np.zeros(1, np.int64), compose)
        return parts.slice(0, 1).select(keys).append_column(step, pa.array(list(whole), pa.list_(pa.float64())))

    schema = own.select(*keys).schema.add(step, T.ArrayType(T.DoubleType()))
    parts = ranged.mapInArrow(run, own.schema).withColumn("part", F.spark_partition_id())
    return parts.groupBy(*keys).applyInArrow(finish, schema)  # a key has a row for each task at most

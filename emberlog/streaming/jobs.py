"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle, TimerValues

from emberlog.functions import text as T
from emberlog.operators.composed import process_sessions
from emberlog.operators.errors import ERROR_SEVERITIES
from emberlog.operators.signals import velocity_score
from emberlog.sources.shared import fresh_path
from emberlog.sources.sinks import payload

#: Groups of a service that a message is compared with, its least similarity, the weight of a new vector.
RECENT_GROUPS, SIMILARITY, ALPHA = 200, 0.85, 0.1
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def velocity(logs: DataFrame, late: str = "5 minutes", seconds: int = 60) -> DataFrame:
    """Error counts of tumbling windows by service and severity over a stream; rows later than the watermark are left out, and a window comes once it is complete."""
    own = logs.where(F.col("severity").isin(ERROR_SEVERITIES)).withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late)
    counts = own.groupBy("service_name", "severity", F.window("event_time", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("error_count"))
    return counts.select("service_name", "severity", F.col("w.start").alias("window_start"), "error_count")


def with_derivatives(windows: DataFrame) -> DataFrame:
    """Differences between windows and velocity scores on a stream of closed windows (following() the table of velocity()), with the last two counts of each key as state.

    What comes of a key in a micro-batch is sorted as a whole (a time and a
    count for each window), however files and Arrow batches cut it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one, two = state.get if state.exists else (None, None)
        parts = [b[["window_start", "error_count"]] for b in batches]
        own = pd.concat(parts).sort_values("window_start", kind="stable")
        n = np.array([*(float("nan") if x is None else float(x) for x in (two, one)), *own["error_count"]], float)
        first, second = n[2:] - n[1:-1], n[2:] - 2 * n[1:-1] + n[:-2]
        last = [None if np.isnan(x) else int(x) for x in n[-2:]]
        state.update((last[1], last[0]))
        for k in range(0, len(own), 10_000):
            part = slice(k, k + 10_000)
            counts = own["error_count"].to_numpy()[part]
            whole = lambda x: np.nan_to_num(x[part]).astype("int64")  # noqa: B023, E731
            yield pd.DataFrame({"service_name": key[0], "severity": key[1], "window_start": own["window_start"].to_numpy()[part], "error_count": counts, "first_derivative": whole(first), "second_derivative": whole(second)})

    out = "service_name string, severity string, window_start timestamp, error_count long, first_derivative long, second_derivative long"
    moved = windows.groupBy("service_name", "severity").applyInPandasWithState(step, out, "one long, two long", "append", GroupStateTimeout.NoTimeout)
    return moved.withColumn("velocity_score", velocity_score(F.col("error_count"), F.col("first_derivative"), F.col("second_derivative")))


def fingerprint_counts(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running counts of error groups; a record that is delivered twice within the watermark counts once."""
    own = logs.where(F.col("severity").isin(ERROR_SEVERITIES)).withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", late)
    once = own.dropDuplicatesWithinWatermark(["id"])
    return once.groupBy("service_name", T.fingerprint(F.col("message")).alias("fingerprint")).agg(
        F.count("*").alias("occurrence_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


class Groups:
    """Semantic groups of one service by fingerprint: the RECENT_GROUPS last used as rows of a matrix, and all others in older, a map with pop and put.

    A message is compared with all recent centroids by one product; a group's
    row is all that changes when it takes a message.
    """

    def __init__(self, older, recent: list[tuple[str, int, list[float]]]):
        """recent: fingerprint, size and centroid, the last used last."""
        self.older, self.slot, self.names = older, {}, [None] * (RECENT_GROUPS + 1)
        self.sizes, self.used, self.clock = np.zeros(RECENT_GROUPS + 1, np.int64), np.full(RECENT_GROUPS + 1, -1), 0
        self.centres, self.norms = None, np.zeros(RECENT_GROUPS + 1)
        for name, n, centroid in recent:
            self._put(name, n, np.array(centroid, float))

    def _put(self, name: str, n: int, centroid: np.ndarray) -> None:
        if self.centres is None:
            self.centres = np.zeros((len(self.names), len(centroid)))
        k = self.slot.setdefault(name, None)
        if k is None:
            k = self.slot[name] = self.names.index(None)
        self.names[k], self.sizes[k], self.centres[k], self.norms[k], self.used[k] = name, n, centroid, np.linalg.norm(centroid), self.clock
        self.clock += 1
        if len(self.slot) > RECENT_GROUPS:
            self._forget(int(np.where(self.used < 0, self.clock, self.used).argmin()))

    def _forget(self, k: int) -> None:
        self.older.put(self.names[k], (int(self.sizes[k]), self.centres[k].tolist()))
        del self.slot[self.names[k]]
        self.names[k], self.sizes[k], self.centres[k], self.norms[k], self.used[k] = None, 0, 0.0, 0.0, -1

    def add(self, print_: str, vector: np.ndarray) -> tuple[str, bool]:
        """The group of a message: that of its fingerprint among all groups, else the most similar recent one (of equally similar ones that used longest ago), else a new one."""
        name, k = print_, self.slot.get(print_)
        group = (int(self.sizes[k]), self.centres[k]) if k is not None else self.older.pop(print_)
        if group is None and (k := self._similar(vector)) is not None:
            name, group = self.names[k], (int(self.sizes[k]), self.centres[k])
        if group is None:
            self._put(name, 1, np.round(vector, 6))
        else:
            self._put(name, group[0] + 1, np.round((1 - ALPHA) * np.array(group[1]) + ALPHA * vector, 6))
        return name, group is None

    def _similar(self, vector: np.ndarray) -> int | None:
        length = np.linalg.norm(vector)
        if not self.slot or not length > 0:
            return None
        size = self.norms * length
        similar = np.divide(self.centres @ vector, size, out=np.zeros(len(size)), where=size > 0)
        similar[self.used < 0] = -2
        best = similar.max()
        first = np.flatnonzero(similar == best)
        return int(first[self.used[first].argmin()]) if best >= SIMILARITY else None

    def recent(self) -> list[tuple[str, int, list[float]]]:
        order = sorted(self.slot.values(), key=lambda k: self.used[k])
        return [(self.names[k], int(self.sizes[k]), self.centres[k].tolist()) for k in order]


class _Older:
    """Groups by fingerprint in a MapState, a row each."""

    def __init__(self, state: MapState):
        self.state = state

    def pop(self, print_: str) -> tuple[int, list[float]] | None:
        if not self.state.containsKey((print_,)):
            return None
        n, centroid = self.state.getValue((print_,))
        self.state.removeKey((print_,))
        return int(n), list(centroid)

    def put(self, print_: str, group: tuple[int, list[float]]) -> None:
        self.state.updateValue((print_,), group)


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """id, fingerprint, embedding of all rows by time and id (null times last).

    They are held as arrays of one micro-batch, which the source's limit of
    files or bytes for a trigger bounds; nothing goes to a local disk.
    """
    own = pd.concat([*frames], ignore_index=True)
    at = own["timestamp"].astype("datetime64[us]").astype("int64").where(own["timestamp"].notna(), np.iinfo(np.int64).max)
    order = np.lexsort((own["id"].to_numpy(), at.to_numpy()))
    ids, prints, vectors = (own[c].to_numpy() for c in ("id", "fingerprint", "embedding"))
    yield from ((int(ids[k]), prints[k], vectors[k]) for k in order)


class _SemanticGroups(StatefulProcessor):
    """All groups of a service: the recent ones in one value, the others in a map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.older = _Older(handle.getMapState("older", "fingerprint string", "n long, centroid array<double>"))
        self.recent = handle.getValueState("recent", "prints array<string>, counts array<long>, centroids array<array<double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        prints, counts, centres = self.recent.get() if self.recent.exists() else ([], [], [])
        groups = Groups(self.older, list(zip(prints, counts, centres, strict=True)))
        own = ((key[0], i, *groups.add(p, np.array(v, float))) for i, p, v in in_order(rows))
        while some := list(islice(own, 10_000)):
            yield pd.DataFrame(some, columns=["service_name", "id", "group_fingerprint", "is_new"])
        kept = groups.recent()
        self.recent.update(tuple([r[k] for r in kept] for k in range(3)))

    def close(self) -> None:
        pass


_DEDUP = "service_name string, id long, group_fingerprint string, is_new boolean"


def semantic_dedup(records: DataFrame) -> DataFrame:
    """service_name, id, group_fingerprint, is_new for a stream of records (service_name, id, timestamp, message, embedding).

    Records of a service are taken in order of time and id within a batch.
    The state has every group of a service, as an old fingerprint may come
    back; only the RECENT_GROUPS last are compared by similarity. The state
    is kept in RocksDB, which the session's settings are changed to.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    own = records.select("service_name", "id", "timestamp", T.fingerprint(F.col("message")).alias("fingerprint"), "embedding")
    return own.groupBy("service_name").transformWithStateInPandas(_SemanticGroups(), _DEDUP, "append", "none")


def silence(logs: DataFrame, minutes: int = 15, least: int = 10, days: int = 7) -> DataFrame:
    """service_name, last_seen, records for each service that had least records in days and then has sent nothing for minutes of event time, raised by the state's timer as others' rows move the watermark.

    The state is the least latest times, which tell whether there were so many
    in days, and the number of all records. A service that comes back can fall silent again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, n = state.get if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            silent = latest[-1] + minutes * 60_000_000
            if len(latest) >= least and latest[-least] >= silent - days * 86_400_000_000:
                yield pd.DataFrame([(key[0], pd.Timestamp(latest[-1], unit="us"), n)], columns=["service_name", "last_seen", "records"])
            return
        for b in batches:
            times = b["event_time"].to_numpy().astype("datetime64[us]").astype("int64")
            latest, n = sorted([*latest, *np.sort(times)[-least:].tolist()])[-least:], n + len(b)
        state.update((latest, n))
        state.setTimeoutTimestamp(max(latest[-1] // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    own = logs.where("timestamp is not null").withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", "1 minute")
    out = "service_name string, last_seen timestamp, records long"
    return own.select("service_name", "event_time").groupBy("service_name").applyInPandasWithState(step, out, "latest array<long>, records long", "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Alerts to two sinks, once for each batch: the table under path, and messages for subscribers beside it. A batch that is tried again overwrites its own folders."""

    def deliver(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        kept.select(payload(*kept.columns).alias("value")).write.mode("overwrite").text(f"{path}/messages/batch={number}")
        kept.unpersist()

    return alerts.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)


def ingest(lines: DataFrame, as_of: Column, path: str, checkpoint: str, name: str = "stream") -> DataStreamWriter:
    """Ingests a stream of lines (id, session_id, value); each micro-batch is one commit, so one that is tried again is stored once. Streams into one path need different names."""

    def store(batch: DataFrame, number: int) -> None:
        process_sessions(batch, as_of, path, f"{name}/{number}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def following(stored: DataFrame) -> DataFrame:
    """A stream of the rows of a table of Parquet files that another stream appends to. Windows come closed and in the order of their batches, so what follows needs no watermark."""
    folder = stored.inputFiles()[0].rpartition("/")[0] if stored.inputFiles() else fresh_path(stored.sparkSession, "none")
    stored.sparkSession.createDataFrame([], stored.schema).write.mode("append").parquet(folder)  # so that the folder is there
    return stored.sparkSession.readStream.schema(stored.schema).parquet(folder)


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that a stream over files yields, as a table in the shared folder: it runs until no new file is left. In complete mode the last batch replaces those before."""
    path = fresh_path(spark, name)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", f"{path}/rows")
    else:
        out = out.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

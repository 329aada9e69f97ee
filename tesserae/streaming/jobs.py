"""Structured Streaming forms of the write side: idempotent capture, latest state, rollups, sessions and expiry."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each idempotency key once, however often it is delivered within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def day_rollup(events: DataFrame, time: str, group: str, delay: str = "1 hour") -> DataFrame:
    """Counts by UTC day and group; a day is final once the watermark passes it."""
    return events.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), group).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def latest_state(events: DataFrame, key: str, revision: str, value: str) -> DataFrame:
    """The value of the highest revision of each key, emitted when it changes; late, older revisions change nothing, and
    a key whose value became null (purged) is never set again."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for part in parts:
            for r, v in part.sort_values(revision)[[revision, value]].itertuples(index=False):
                v = None if pd.isna(v) else str(v)
                if best is not None and (best[1] is None or r <= best[0]):
                    continue
                best = (int(r), v)
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame({"key": [str(k[0])], "revision": [best[0]], "value": [best[1]]})

    out = "key string, revision long, value string"
    return events.groupBy(key).applyInPandasWithState(step, out, "revision long, value string", "append", GroupStateTimeout.NoTimeout)


def micro_batches(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run ``write`` on each micro-batch; a failed batch is delivered again with the same number. every=None: what is there, then stop."""
    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str = "1 hour", value: str | None = None) -> DataFrame:
    """key, start, end (of the last row), n and, with ``value``, its sum: rows of a key less than ``gap`` apart are one session.

    A late row within ``delay`` extends or merges the sessions it falls between; one that is later is
    dropped by a stream (a batch takes all). A session is final once the watermark has passed its end by the gap.
    """
    found = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), key)
    sums = [] if value is None else [F.sum(value).alias("total")]
    return found.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), *sums).drop("session")


class Expiry(StatefulProcessor):
    """Holds each key's latest time and value until ``ttl_ms`` has passed without a newer row; then emits and forgets them.

    The timer follows the latest time, so a key's state is gone once the watermark passes it.
    """

    def __init__(self, time: str, value: str, ttl_ms: int) -> None:
        self.time, self.value, self.ttl_ms = time, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, value string, n long")

    def _told(self, key: str, ended: list[tuple]) -> pd.DataFrame:
        """The runs of a key that have ended, as one frame, however many there are."""
        last, values, counts = zip(*ended, strict=True)
        return pd.DataFrame({"key": [key] * len(ended), "last_ms": last, "value": values, "n": counts, "expired_ms": [at + self.ttl_ms for at in last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = before = self.held.get()  # none where nothing is held
        ended: list[tuple] = []
        for part in rows:
            if len(part) > 1:
                part = part.sort_values([self.time, self.value], kind="stable")
            for at, value in zip(part["at_ms"].tolist(), part[self.value].tolist(), strict=True):
                value = None if value is None or pd.isna(value) else str(value)
                if held is not None and at > held[0] + self.ttl_ms:  # it had expired before this row came
                    ended.append(held)
                    held = None
                if held is None:
                    held = (at, value, 1)
                elif at + self.ttl_ms >= held[0]:
                    held = (at, value, held[2] + 1) if at >= held[0] else (held[0], held[1], held[2] + 1)
        if ended:
            yield self._told(str(key[0]), ended)
        if held is not None and held != before:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.ttl_ms)
            self.held.update(held)
            self.handle.registerTimer(held[0] + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (held := self.held.get()) is not None:
            self.held.clear()
            yield self._told(str(key[0]), [held])

    def close(self) -> None:
        pass


def expiries(events: DataFrame, key: str, time: str, value: str, ttl: str, delay: str = "1 hour") -> DataFrame:
    """key, last_ms, value, n, expired_ms: each time a key has had no row for ``ttl``; a stream of runs of a key's rows, told when they end.

    State is kept in RocksDB (``rocksdb_state``) and holds only the keys whose time to live runs. A row that comes more than ``ttl`` before
    the one that is held counts for nothing. A null key is a key.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    out = "key string, last_ms long, value string, n long, expired_ms long"
    rows = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(time).cast("timestamp").alias(time), F.col(value).cast("string").alias(value))
    rows = rows.withColumn("at_ms", F.unix_millis(time))
    return rows.withWatermark(time, delay).groupBy("key").transformWithStateInPandas(Expiry(time, value, ttl_ms), out, "Append", "EventTime")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ``expiries`` needs and which holds more keys than memory does."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replayed(spark: SparkSession, rows: DataFrame, time: str, batches: int, job: Callable[[DataFrame], DataFrame], folder: str, keys: dict) -> DataFrame:
    """The rows that ``job`` emits when ``rows`` come in ``batches`` micro-batches in order of ``time``, and then a row a year later.

    The last row, with ``keys`` for its columns, moves the watermark past all others; what it gives isn't left out here.
    """
    bounds = rows.agg(F.max(time).alias("last")).first().last
    if bounds is None:
        return spark.createDataFrame([], job(rows).schema)
    rows.repartitionByRange(batches, time).withColumn("batch_", F.spark_partition_id()).write.partitionBy("batch_").parquet(f"{folder}/dealt")
    dealt, schema = spark.read.parquet(f"{folder}/dealt"), rows.schema
    parts = [dealt.filter(F.col("batch_") == i).drop("batch_") for i in range(batches)]
    end = {time: bounds + dt.timedelta(days=365)} | keys
    parts.append(spark.range(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]))
    for part in parts:  # each start goes on from the state and the watermark that the one before left in the checkpoint
        part.write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        writer = job(stream).writeStream.format("parquet").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/marks").outputMode("append")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/sink")

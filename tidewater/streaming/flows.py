"""Streams: replayed messages, counting windows, first sightings, gates and limits. Each is a query over any streaming source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewater.functions import vocabulary as v
from tidewater.operators import ingest
from tidewater.sources.storage import VersionedTable


#: Where streams keep their state: on local disk, with its changes in the checkpoint; memory holds a cache only.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(stream: DataFrame) -> DataFrame:
    """``stream``, for a session whose streams keep their state in RocksDB from now on."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream


def without_replays(records: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """``records`` once each, however often the source sends them within ``horizon``; state older than that is dropped."""
    return on_disk(records).withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def append_new(records: DataFrame, stored: VersionedTable, checkpoint: str, schema: str, tenant: str = "tenant_id", most: int = 64) -> StreamingQuery:
    """Add each micro-batch's records to a table, but for those it has, by either key, however old. A batch that is run again adds nothing.

    Of what is stored only the keys are read. When over ``most`` small versions hold, they are gathered into one.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = stored.read()
        held = spark.createDataFrame([], schema) if held is None else held
        order = [F.col("sent_at"), F.col("content_hash")]
        fresh = ingest.either_key(ingest.not_stored(batch, held, tenant), [tenant], order).where("first").drop("first")
        stored.append(fresh.select(*held.columns))
        stored.compacted(most)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(hits: DataFrame, by: list[str], at: str, seconds: int, limit: int, late: str) -> DataFrame:
    """(by, window_start, attempts, refused) of closed windows; a window's state goes once it is ``late`` behind."""
    counted = on_disk(hits).withWatermark(at, late).groupBy(*by, F.window(at, f"{seconds} seconds")).agg(F.least(F.count("*"), F.lit(limit + 1)).alias("attempts"))
    return counted.select(*by, F.col("window.start").alias("window_start"), "attempts", (F.col("attempts") > limit).alias("refused"))


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """The first event of each key, ever: the state is one entry for each key, on disk."""
    return on_disk(events).dropDuplicates([key])


class Admission(StatefulProcessor):
    """Of each key the times of those let in last, at most ``most``, until the newest has left the window."""

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["us"].to_numpy(), p["row"].to_numpy()) for p in rows]  # numbers only: a batch's rows of a key go in order of time
        us, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, us))
        us, row = us[order], row[order]
        held, good = [x[0] for x in self.held.get()], np.zeros(len(us), bool)
        for i, t in enumerate(us.tolist()):
            held = [h for h in held if h > t - self.width]
            if len(held) < self.most:
                good[i] = True
                held.append(t)
        if held:
            self.held.put([(int(t),) for t in held])
            self._forget_after((max(held) + self.width) // 1000, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": key[0], "row": row, "us": us, "let_in": good})

    def _forget_after(self, at: int, now: int) -> None:
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        self.handle.registerTimer(max(now + 1, at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def admitted(hits: DataFrame, key: str, at: str, row_id: str, most: int = 10, window_s: int = 3600) -> DataFrame:
    """(key, row id, at, let_in): the trailing limit of ``operators.sequences.admitted`` over a stream.

    A key's state is the times of those let in, at most ``most``; a timer ends it when the newest of them has left the window. Rows of a
    micro-batch are taken in order of time, of batches as they come; rows over ``window_s`` late are left out, and counted by Spark.
    """
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    rows = on_disk(hits).withWatermark(at, f"{window_s} seconds").select(F.col(key).alias("key"), F.col(row_id).alias("row"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), at)
    schema = f"key {kinds[key]}, row {kinds[row_id]}, us long, let_in boolean"
    out = rows.groupBy("key").transformWithStateInPandas(Admission(most, window_s * 1_000_000), schema, "Append", "eventTime")
    return out.select(F.col("key").alias(key), F.col("row").alias(row_id), F.timestamp_micros("us").alias(at), "let_in")


class Gate(StatefulProcessor):
    """Of each key how many messages wait, and since when; a timer for the oldest."""

    def __init__(self, count: int, age_s: int):
        self.count, self.age = count, age_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "n long, oldest long")

    def _fired(self, key, n: int, oldest: int, cause: str) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.waits.clear()
        return pd.DataFrame({"key": [key[0]], "waiting": [n], "oldest": [pd.Timestamp(oldest, unit="us")], "cause": [cause]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, oldest = self.waits.get() if self.waits.exists() else (0, None)
        for part in rows:
            n, oldest = n + len(part), min([int(part["us"].min()), *([oldest] if oldest is not None else [])])
        if n >= self.count:
            yield self._fired(key, n, oldest, "count")
            return
        self.waits.update((n, oldest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, oldest // 1000 + self.age + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waits.exists():
            yield self._fired(key, *self.waits.get(), "age")

    def close(self) -> None:
        pass


def gate(messages: DataFrame, key: str, at: str, count: int = v.GATE_COUNT, age_s: int = v.GATE_AGE_S, arrived: str | None = None) -> DataFrame:
    """(key, waiting, oldest, cause): fires once a key has ``count`` messages waiting, or its oldest has waited longer than ``age_s``.

    ``at`` is when a message was sent, in whatever order they come: all are counted. What passes as now is when they ``arrived`` (a column that
    grows as they come in; by default the clock), so no message is late.
    """
    kind = messages.schema[key].dataType.simpleString()
    now = F.current_timestamp() if arrived is None else F.col(arrived).cast("timestamp")
    rows = on_disk(messages).withColumn("_now", now).withWatermark("_now", "0 seconds").select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), "_now")
    out = rows.groupBy("key").transformWithStateInPandas(Gate(count, age_s), f"key {kind}, waiting long, oldest timestamp, cause string", "Append", "eventTime")
    return out.withColumnRenamed("key", key)


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """What a stream gives for all that its source has now, written under ``folder`` and read again."""
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")



"""The same over a stream: a group's first sighting is kept for ever, and a join that came alone is held until a timer asks again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions import vocabulary as v
from tidewater.operators.joins import slots
from tidewater.streaming.flows import on_disk

class FirstSighting(StatefulProcessor):
    """A group's first event; a value for each group, on disk, says that it was seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r.us, r.row))
        self.seen.update((first.us,))
        yield Row(group=key[0], us=first.us, row=first.row, kind=first.kind, at=first.at)

    def close(self) -> None:
        pass


def _counted(times: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the sorted ``times`` are over ``low`` and at most ``high``."""
    return np.searchsorted(times, high, "right") - np.searchsorted(times, low, "right")


class Desk(StatefulProcessor):
    """A slot's sightings, and its own joins that came alone until now, each with a timer."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getListState("near", "us long")
        self.held = handle.getMapState("held", "row long", "us long, group string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        self.near.appendList([(x,) for part in parts for x in part["us"].tolist()])
        asked = pd.concat([part[part["own"] & part["join"]] for part in parts])
        self.handle.registerTimer((key[0] + 3) * self.width // 1000 + 1)  # by then nobody asks any more
        if asked.empty:
            return
        us = asked["us"].to_numpy()
        burst = _counted(self._sightings(), us - self.width, us) > 1
        for join in asked[~burst][["us", "row", "group"]].itertuples(index=False):
            self.held.updateValue((int(join.row),), (int(join.us), join.group))
            self.handle.registerTimer(join.us // 1000 + self.width // 1000 + 1)
        yield asked[burst][["group", "row"]].assign(outcome="burst_suppressed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [(us, row, group) for (row,), (us, group) in self.held.iterator() if us // 1000 + self.width // 1000 + 1 <= now]
        if due:
            us = np.array([x[0] for x in due])
            alone = _counted(self._sightings(), us - self.width, us + self.width) <= 1
            for _, row, _ in due:
                self.held.removeKey((row,))
            yield pd.DataFrame([(group, row, "welcomed" if a else "withheld") for (_, row, group), a in zip(due, alone, strict=True)], columns=["group", "row", "outcome"])
        if now > (key[0] + 3) * self.width // 1000:
            self.near.clear()

    def _sightings(self) -> np.ndarray:
        return np.sort(np.fromiter((x[0] for x in self.near.get()), np.int64))

    def close(self) -> None:
        pass


def joins(events: DataFrame, group: str, at: str, kind: str, row: str, late: str = "0 seconds", window_s: int = v.JOIN_BURST_S, joined: str = "joined") -> DataFrame:
    """(group, row, outcome) of the joins that are a group's first event, as ``operators.joins.outcomes`` gives it.

    A join is refused in the micro-batch that shows it not to be alone; others are held, and asked about again once ``at`` has gone on by ``window_s``
    (and ``late``, by which events may come out of order; those that come later are dropped and counted by Spark). Of a group only its first
    sighting is kept. State is on disk, in RocksDB, which this sets for the session; it outlives restarts from the same checkpoint.
    """
    width = window_s * 1_000_000
    rows = on_disk(events).withWatermark(at, late).where(F.col(group).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(F.col(group).cast("string").alias("group"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(row).cast("long").alias("row"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(at).alias("at"))
    seen = rows.groupBy("group").transformWithState(FirstSighting(), "group string, us long, row long, kind string, at timestamp", "Append", "eventTime", eventTimeColumnName="at")
    near = slots(seen.withColumn("join", F.col("kind") == joined), F.col("us"), width)
    near = near.select("slot", "group", "us", "row", "own", "join", "at")
    return near.groupBy("slot").transformWithStateInPandas(Desk(width), "group string, row long, outcome string", "Append", "eventTime")

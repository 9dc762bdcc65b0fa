"""Confirmed demotions of a stream of lifecycle events: arbitrary state a source, and timers in event time.

Events wait until the watermark has passed them, so that they are judged in order however they come in.  What
stays of them is the last demotion and the last reset, and nothing of a source whose last demotion is too
long ago to be confirmed.  State lives in RocksDB and its changelog goes to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsdesk.config import DEMOTE_DAYS

WAITING = "at timestamp, event_id long, action string, condition_keys array<string>"
FOUND = "source_id long, event_id long, at timestamp"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _ms(at: Any) -> int:
    return round(at.timestamp() * 1000)


class Demotions(StatefulProcessor):
    """One source's waiting events, last demotion and last reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.demotion = handle.getValueState("demotion", "at timestamp, condition_keys array<string>")
        self.reset = handle.getValueState("reset", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            self.waiting.appendValue((r.at, r.event_id, r.action, r.condition_keys))
            self.handle.registerTimer(_ms(r.at) + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = list(self.waiting.get())
        due = sorted((r for r in waiting if _ms(r[0]) < now), key=lambda r: (r[0], r[1]))
        left = [tuple(r) for r in waiting if _ms(r[0]) >= now]
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        last = self.demotion.get() if self.demotion.exists() else None
        reset = self.reset.get() if self.reset.exists() else None
        out = []
        low, high = (timedelta(days=d) for d in DEMOTE_DAYS)
        for at, event_id, action, keys in due:
            if action != "demote":
                reset = (at,)
                continue
            if last and low <= at - last[0] <= high and (reset is None or reset[0] < last[0]) and set(keys or ()) & set(last[1] or ()):
                out.append(Row(source_id=key[0], event_id=event_id, at=at))
            last = (at, keys)
            # One more than the last moment at which this demotion may be confirmed.
            self.handle.registerTimer(_ms(at) + DEMOTE_DAYS[1] * DAY_MS + 2)
        if last and _ms(last[0]) + DEMOTE_DAYS[1] * DAY_MS + 1 < now:
            last = reset = None
        for state, value in ((self.demotion, last), (self.reset, reset)):
            if value is not None:
                state.update(tuple(value))
            elif state.exists():
                state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def confirmed(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """(source_id, event_id, at) of demotions that confirm one of 6 to 8 days before, as the batch plan finds them.

    ``events`` is a stream of source_id, at, event_id, action and condition_keys; rows later than ``delay`` are dropped.
    """
    use_rocksdb(events.sparkSession)
    rows = events.selectExpr("cast(source_id as long) as source_id", "at", "cast(event_id as long) as event_id", "action", "condition_keys")
    return rows.withWatermark("at", delay).groupBy("source_id").transformWithState(Demotions(), outputStructType=FOUND, outputMode="Append", timeMode="EventTime")

"""The outcome of ingestion jobs from their polls: as a stream with timers, and the same rule over a table.

A job ends with the first of these: a poll says ``success`` or ``failed``; the third ``unknown`` in a row (``lost``); so many
minutes after its first poll (``overdue``), whether or not polls go on.  What comes later is not heeded.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a job may take, and after how many polls in a row that know nothing it is lost.
MINUTES, UNKNOWN = 60, 3

OUTCOME = "manual_id string, outcome string, polls bigint, ended timestamp"


class _Watch(StatefulProcessor):
    """State of a job: first poll, unknown polls in a row, polls; ``done`` stays, so that late polls say nothing."""

    def __init__(self, minutes: int, unknown: int):
        self.minutes, self.unknown = minutes, unknown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "started long, streak int, polls long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, streak, polls, done = self.job.get() if self.job.exists() else (None, 0, 0, False)
        if done:
            return
        got = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        new, limit = started is None, timedelta(minutes=self.minutes) // timedelta(milliseconds=1)
        for at, status in zip(got["at"], got["status"]):
            ms = at.value // 1_000_000
            if started is None:
                started = ms
            if ms >= started + limit:
                break  # the timer has the last word
            polls += 1
            streak = streak + 1 if status == "unknown" else 0
            if status in ("success", "failed") or streak >= self.unknown:
                self.job.update((started, streak, polls, True))
                for t in [] if new else list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                yield self._row(key, status if status in ("success", "failed") else "lost", polls, ms)
                return
        self.job.update((started, streak, polls, False))
        if new:
            self.handle.registerTimer(started + limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, streak, polls, done = self.job.get()
        if not done:
            self.job.update((started, streak, polls, True))
            yield self._row(key, "overdue", polls, expiredTimerInfo.getExpiryTimeInMs())

    @staticmethod
    def _row(key, outcome: str, polls: int, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"manual_id": [key[0]], "outcome": [outcome], "polls": [polls], "ended": [pd.Timestamp(ms, unit="ms")]})

    def close(self) -> None:
        pass


def watch(polls: DataFrame, minutes: int = MINUTES, unknown: int = UNKNOWN, late: str = "0 seconds") -> DataFrame:
    """A stream of polls(manual_id, at, seq, status) -> manual_id, outcome, polls, ended: one row for each job when it ends.

    Time is that of the polls: a job is overdue when the watermark (``late`` behind the latest poll of any job) passes its limit.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    timed = polls.where("manual_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy("manual_id").transformWithStateInPandas(_Watch(minutes, unknown), OUTCOME, "append", "eventTime")


def outcomes(polls: DataFrame, minutes: int = MINUTES, unknown: int = UNKNOWN) -> DataFrame:
    """The same over a table: manual_id, outcome, polls, ended; ``processing`` (without an end) where the limit lies behind the last poll of all."""
    known = polls.where("manual_id IS NOT NULL AND at IS NOT NULL")
    limits = known.groupBy("manual_id").agg((F.min("at") + F.expr(f"make_interval(0, 0, 0, 0, 0, {minutes})")).alias("limit"))
    seen = known.join(limits, "manual_id").where(F.col("at") < F.col("limit"))
    w = Window.partitionBy("manual_id").orderBy("at", "seq")
    blank = F.coalesce(F.col("status"), F.lit("")) == "unknown"
    seen = seen.withColumns({"place": F.row_number().over(w), "run": F.sum(F.when(blank, 0).otherwise(1)).over(w)})
    seen = seen.withColumn("streak", F.when(blank, F.row_number().over(Window.partitionBy("manual_id", "run", blank).orderBy("at", "seq"))).otherwise(0))
    says = F.when(F.col("status").isin("success", "failed"), F.col("status")).when(F.col("streak") >= unknown, "lost")
    first = seen.withColumn("says", says).groupBy("manual_id", "limit").agg(F.min(F.when(F.col("says").isNotNull(), F.struct("place", "says", "at"))).alias("end"), F.count("*").alias("n"))
    now = known.agg(F.max("at").alias("now"))
    over = F.col("now") >= F.col("limit")
    found = first.crossJoin(F.broadcast(now))  # one row
    return found.select(
        "manual_id", F.coalesce("end.says", F.when(over, "overdue").otherwise("processing")).alias("outcome"),
        F.coalesce(F.col("end.place").cast("bigint"), F.col("n")).alias("polls"), F.coalesce("end.at", F.when(over, F.col("limit"))).alias("ended"),
    )

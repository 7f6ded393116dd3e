"""Live expiry of jobs: a keyed state with an event-time timer for each job, as the batch form ``expirations`` defines it.

A job's state is the time of its last use and how many of its tasks are active.  Every event touches it, lookups
included.  A job not used for longer than the time to live, and without an active task, expires; one with an active task
waits until the task ends.  An event after the expiry begins a new state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

EXPIRED = "key string, last_access timestamp"
#: Events that begin and end a task of a job; any other is a use of it.
BEGIN, END = "begin", "end"


def expirations(events: DataFrame, ttl_seconds: int, now) -> DataFrame:
    """(key, last_access) of every expiry among events (key, at, what) up to ``now``, a timestamp column.

    Events of a key at one time count as one moment; tasks are counted after it.
    """
    step = F.when(F.col("what") == BEGIN, 1).when(F.col("what") == END, -1).otherwise(0)
    moments = events.groupBy("key", "at").agg(F.sum(step).alias("d"))
    line = Window.partitionBy("key").orderBy("at")
    state = moments.select("key", "at", F.sum("d").over(line).alias("active"), F.coalesce(F.lead("at").over(line), now).alias("until"))
    quiet = F.unix_micros("until") - F.unix_micros("at") > ttl_seconds * 1_000_000
    return state.where((F.col("active") <= 0) & quiet).select("key", F.col("at").alias("last_access"))


class _Expiry(StatefulProcessor):
    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "last_us long, active int")

    def _arm(self, last: int, active: int) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if active <= 0:
            # timers fire once the watermark has passed them, and are in whole milliseconds
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def _gone(self, key, last: int) -> pd.DataFrame:
        at = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=last)
        return pd.DataFrame({"key": [key[0]], "last_access": [pd.Timestamp(at).tz_localize(None)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        step = new["what"].map({BEGIN: 1, END: -1}).fillna(0).astype(int)
        moments = step.groupby(new["us"]).sum().sort_index()
        last, active = self.state.get() if self.state.exists() else (None, 0)
        for us, d in moments.items():
            if last is not None and active <= 0 and us - last > self.ttl:
                yield self._gone(key, last)
                active = 0
            last, active = us if last is None else max(us, last), active + int(d)
        self.state.update((int(last), int(active)))
        self._arm(int(last), int(active))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, active = self.state.get()
            if active <= 0:
                self.state.clear()
                yield self._gone(key, last)

    def close(self) -> None:
        pass


def live_expirations(events: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same from a stream of events (key string, at timestamp, what string), each expiry once the watermark has passed it.

    The session must use the RocksDB state store.  Events may come late by ``late``; later ones are dropped, as are the
    expiries that they would have put off.
    """
    marked = events.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return marked.groupBy("key").transformWithStateInPandas(_Expiry(ttl_seconds), EXPIRED, "Append", "EventTime")

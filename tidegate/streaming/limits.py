"""A sliding rate limit over a stream whose rows come out of order, in state with timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.config import DEFAULTS, Defaults

#: What the session has to have for state with timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "user_id long, event_id long, admitted boolean"


class SlidingLimit(StatefulProcessor):
    """Rows wait until the watermark has passed their time and are then decided in order of time, as a replay would.

    State is the waiting rows of a key, and the times admitted in its last window, at most the limit. A timer is set for the
    earliest row that waits; when none does, one for the end of the window, at which the key's state is cleared.
    """

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_us = limit, int(window_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, event_id long")
        self.admitted = handle.getValueState("admitted", "times array<long>")

    def _timer(self, at_us: int) -> None:
        """One timer a key: it fires once the watermark is beyond the time."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(e)) for pdf in rows for t, e in zip(pdf["t_us"], pdf["event_id"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._timer(min(t for t, _ in self.waiting.get()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(r[0]), int(r[1])) for r in self.waiting.get())
        due, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        seen = list(self.admitted.get()[0]) if self.admitted.exists() else []
        out = []
        for t, event in due:
            seen = [x for x in seen if t - x <= self.window_us]
            out.append((event, len(seen) < self.limit))
            if out[-1][1]:
                seen.append(t)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if later or any(mark - x <= self.window_us for x in seen):
            self.admitted.update((seen,))
            self._timer(later[0][0] if later else max(seen) + self.window_us + 1000)
        else:
            self.admitted.clear()
        if out:
            yield pd.DataFrame({"user_id": key[0], "event_id": [e for e, _ in out], "admitted": [a for _, a in out]})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, late: str = "10 minutes", d: Defaults = DEFAULTS) -> DataFrame:
    """(user_id, event_id, admitted) over a stream of (user_id, event_id, ts): fewer than the limit were admitted in the window before.

    Rows may come up to ``late`` out of order and are decided in order of ts, then event_id; later ones are dropped with the
    watermark, and a row is decided when the watermark has passed it. The session needs ``STATE_STORE``.
    """
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("t_us", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(SlidingLimit(d.rate_limit, d.rate_window_s), OUT, "append", "eventTime")

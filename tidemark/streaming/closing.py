"""Windows that close while items still arrive: each boundary's counts once, and what came too late for them.

State is kept for each key (a source of items): how many items each day has, how far the key's clock has come (the latest
time seen), and how many of the boundaries are closed. A window closes when the clock has passed its boundary by a delay;
with an idle time, a timer closes what is open when a key falls silent. What belongs to a window that is closed isn't dropped but
counted: it comes out as a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
COUNTS = "boundary date, kind string, n_before long, n_in long, n_after long"


class Closing(StatefulProcessor):
    """boundaries: days since 1970 in order. days: length of a window; delay: seconds after the end of a boundary's day; idle: milliseconds, or None."""

    def __init__(self, boundaries: Sequence[int], days: int, delay: float, idle: int | None):
        self.boundaries, self.days, self.delay, self.idle = np.array(sorted(set(boundaries)), np.int64), days, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day long", "n long, out long")
        self.clock = handle.getValueState("clock", "seconds double, closed long")

    def _before(self) -> Iterator[tuple[int, int, int]]:
        for day, value in self.counts.iterator():
            yield day[0], value[0], value[1]

    def _close(self, key, first: int, last: int) -> pd.DataFrame:
        """Rows of the boundaries from first to last - 1."""
        known = sorted(self._before())
        day, n, out = (np.array(c, np.int64) for c in zip(*known)) if known else (np.zeros(0, np.int64),) * 3
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = self.boundaries[first:last]
        before = upto[np.searchsorted(day, ends - self.days + 1)]
        at = np.searchsorted(day, ends, "right")
        late = np.array([out[i - 1] if i and day[i - 1] == b else 0 for i, b in zip(at, ends)], np.int64)
        within = upto[at] - before - late
        return self._rows(key, ends, "closed", before, within, upto[-1] - before - within)

    @staticmethod
    def _rows(key, ends: np.ndarray, kind: str, *counts: np.ndarray) -> pd.DataFrame:
        days = pd.to_datetime(ends, unit="D").date
        return pd.DataFrame({"key": key[0], "boundary": days, "kind": kind, "n_before": counts[0], "n_in": counts[1], "n_after": counts[2]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds, closed = self.clock.get() if self.clock.exists() else (-np.inf, 0)
        times = pd.concat([r["seconds"] for r in rows], ignore_index=True).dropna().to_numpy(float)
        if not len(times):
            return
        day = np.floor(times / DAY).astype(np.int64)
        out = times - day * DAY > DAY - 1
        for d in np.unique(day).tolist():
            old = self.counts.getValue((d,)) if self.counts.containsKey((d,)) else (0, 0)
            here = day == d
            self.counts.updateValue((d,), (int(old[0] + here.sum()), int(old[1] + (here & out).sum())))
        if closed:
            done = self.boundaries[:closed]
            ordered, inside = np.sort(day), np.sort(day[~out])
            upto = lambda values, at, side: np.searchsorted(values, at, side)
            # Whole days before the boundary's, and of that day what isn't out.
            n = upto(ordered, done, "left") - upto(ordered, done - self.days + 1, "left") + upto(inside, done, "right") - upto(inside, done, "left")
            some = n > 0
            if some.any():
                yield self._rows(key, done[some], "late", np.zeros(some.sum(), np.int64), n[some], np.zeros(some.sum(), np.int64))
        seconds = max(seconds, float(times.max()))
        last = int(np.searchsorted((self.boundaries + 1) * DAY + self.delay, seconds, "right"))
        if last > closed:
            yield self._close(key, closed, last)
        self.clock.update((seconds, max(last, closed)))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seconds, closed = self.clock.get()
        # Only boundaries up to the last day seen: what lies beyond hasn't happened yet.
        last = int(np.searchsorted(self.boundaries, np.floor(seconds / DAY), "right"))
        if last > closed:
            yield self._close(key, closed, last)
            self.clock.update((seconds, last))

    def close(self) -> None:
        pass


def closed_windows(
    stream: DataFrame, boundaries: Sequence[date], days: int = 14, delay: str = "1 day", key: str = "source", published: str = "published", idle_ms: int | None = None,
) -> DataFrame:
    """(key, boundary, kind, n_before, n_in, n_after) of a stream of items. kind `closed`: once for each key and boundary, when the key's latest item is `delay` past the
    end of the boundary's day: how many of the items so far come before the window, in it and after it. kind `late`: how many items of a batch belong to
    a window that is closed already (n_in alone); closed and late rows add up to all items of the window, in whatever order they come. With
    idle_ms windows up to the last day seen also close when a key has been silent for so long. Items without a time count nowhere. boundaries: a
    bounded list of days. Needs the RocksDB state store (use_rocksdb)."""
    wait = stream.sparkSession.range(1).select(F.expr(f"INTERVAL {delay}").alias("w")).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.col("w")) / 1e6).alias("s")).first().s
    rows = stream.select(F.col(key).alias("key"), (F.unix_micros(F.col(published).cast("timestamp")) / 1e6).alias("seconds"))
    kind = stream.schema[key].dataType.simpleString()
    epoch = [(b - date(1970, 1, 1)).days for b in boundaries if b is not None]
    mode = "none" if idle_ms is None else "processingTime"
    out = rows.groupBy("key").transformWithStateInPandas(Closing(epoch, days, wait, idle_ms), f"key {kind}, {COUNTS}", "append", mode)
    return out.withColumnRenamed("key", key)


def use_rocksdb(spark) -> None:
    """Streams that start from now on keep state that has timers and maps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

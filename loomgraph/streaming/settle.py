"""Bursts of changes that settle: a quiet period, a stability check and epochs as stream state.

Each project has state of its own: an epoch, that every change of a file moves
on; the first and last change and the paths that wait; and a timer. A change
sets the timer to the quiet period after the last one. When it fires, the
project's paths become a candidate, which has to stay unchanged for the
stability time (a second timer); then they are handed on, once, with their
epoch. A build that is reported for an epoch is published only if no change has
come since; else it is stale, and its paths wait with the newer ones.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Changes have a path; builds (kind ``built``) the epoch they are of.
EVENTS = "project string, kind string, path string, epoch long, ts timestamp"
OUT = T.StructType([T.StructField("project", T.StringType()), T.StructField("event", T.StringType()), T.StructField("epoch", T.LongType()), T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType()), T.StructField("paths", T.ArrayType(T.StringType()))])
#: Milliseconds: no change for so long, then none for so long again.
QUIET, STABILITY = 250, 100
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _when(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000)


def _ms(ts: datetime.datetime) -> int:
    return round(ts.timestamp() * 1000)


class Settle(StatefulProcessor):
    """quiet and stability in milliseconds of the stream's time, or of the machine's."""

    by_clock = False

    def __init__(self, quiet: int = QUIET, stability: int = STABILITY):
        self.quiet, self.stability = quiet, stability

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # epoch, first and last change, phase: 0 nothing waits, 1 until quiet, 2 until stable, 3 handed on and being built
        self.state = handle.getValueState("state", "epoch long, first long, last long, phase int")
        self.paths = handle.getMapState("paths", "path string", "last long")

    def _now(self) -> tuple[int, int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0)

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _row(self, project: str, event: str, epoch: int, first: int, last: int) -> Row:
        return Row(project=project, event=event, epoch=epoch, first=_when(first), last=_when(last), paths=sorted(k[0] for k in self.paths.keys()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        epoch, first, last, phase = self._now()
        built, changed = [], False
        for r in rows:
            if r.kind == "built":
                built.append(r.epoch)
                continue
            at = _ms(r.ts)
            # what was handed on and isn't published stays with what comes now
            first, last = (min(first, at), max(last, at)) if phase else (at, at)
            epoch, phase, changed = epoch + 1, 1, True
            self.paths.updateValue((r.path,), (at,))
        if changed:
            now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else last
            self._timer(max(now, last) + self.quiet)
        # builds that were reported with changes are of an epoch before them
        for of in sorted(set(built)):
            if of == epoch and phase == 3:
                yield self._row(key[0], "published", of, first, last)
                self.paths.clear()
                phase = 0
            else:
                yield Row(project=key[0], event="stale", epoch=of, first=None, last=None, paths=[])
        self.state.update((epoch, first, last, phase))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        epoch, first, last, phase = self._now()
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        stable = expiredTimerInfo.getExpiryTimeInMs() + self.stability
        if phase == 1 and stable > now:
            self.state.update((epoch, first, last, 2))
            self.handle.registerTimer(stable)
        elif phase:
            # every change sets the phase back and the timer on, so no change has come since
            self.state.update((epoch, first, last, 3))
            yield self._row(key[0], "settled", epoch, first, last)

    def close(self) -> None:
        pass


class SettleByClock(Settle):
    by_clock = True


def settling(events: DataFrame, quiet: int = QUIET, stability: int = STABILITY, by_clock: bool = False, delay: str = "0 seconds") -> DataFrame:
    """(project, event, epoch, first, last, paths) of a stream of events as EVENTS.

    event: settled, when a project's changes have been quiet and stable;
    published, when the build of the current epoch is reported; stale, when
    that of an earlier one is. Time is the events' own, with a watermark that
    lags by delay; by_clock: the machine's.
    """
    stateful_store(events.sparkSession)
    if not by_clock:
        events = events.withWatermark("ts", delay)
    processor = (SettleByClock if by_clock else Settle)(quiet, stability)
    return events.groupBy("project").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")


def stateful_store(spark: SparkSession) -> None:
    """Timers and maps need the store that has column families."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

"""Event operators with state of their own: the last lines of a run, and starts that nothing finished in time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LOG_SCHEMA = "run_id string, seq long, type string"
PENDING_SCHEMA = "run_id string, item_key string, started long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep lists and timers by key, which need the RocksDB store; the session's own choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _LastLines(StatefulProcessor):
    """Keeps the ``most`` last lines of a run by seq. A line that comes again is there once, one that comes late takes its place."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "seq long, type string")

    def handleInputRows(self, key, rows, timerValues):
        held = {line[0]: line[1] for line in self.lines.get()} if self.lines.exists() else {}
        for row in rows:
            held[row.seq] = row.type
            if len(held) > 2 * self.most:
                held = dict(sorted(held.items())[-self.most :])
        last = sorted(held.items())[-self.most :]
        self.lines.put(last)
        for seq, kind in last:
            yield Row(run_id=key[0], seq=seq, type=kind)

    def close(self) -> None:
        pass


class _Unfinished(StatefulProcessor):
    """Keeps the open starts of an item and the times it was done; a start is pending if nothing finished it within ``wait`` ms.

    Whatever order events come in: a start waits for its timer, and a time of completion stays until no start from before it
    can come any more (the watermark has passed it).
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "seq long, at long")
        self.done = handle.getListState("done", "at long")

    def _held(self, state) -> list[tuple]:
        return [tuple(x) for x in state.get()] if state.exists() else []

    def _keep(self, state, values: list[tuple]) -> None:
        state.put(values) if values else state.clear()

    def handleInputRows(self, key, rows, timerValues):
        starts, done = set(self._held(self.open)), {x[0] for x in self._held(self.done)}
        before = {at for _, at in starts}
        for row in rows:
            if row.type == "page-start" and row.at is not None:
                starts.add((row.seq, row.at))
            elif row.type == "page-done" and row.at is not None:
                done.add(row.at)
        starts = {(seq, at) for seq, at in starts if not any(at <= d <= at + self.wait for d in done)}
        now = {at for _, at in starts}
        for at in before - now:
            self.handle.deleteTimer(at + self.wait)
        for at in now - before:
            self.handle.registerTimer(at + self.wait)
        mark = timerValues.getCurrentWatermarkInMs()
        self._keep(self.open, sorted(starts))
        self._keep(self.done, sorted((d,) for d in done if d >= mark))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs() - self.wait
        starts = self._held(self.open)
        mark = timerValues.getCurrentWatermarkInMs()
        self._keep(self.open, [x for x in starts if x[1] != due])
        self._keep(self.done, [x for x in self._held(self.done) if x[0] >= mark])
        for seq, at in starts:
            if at == due:
                yield Row(run_id=key[0], item_key=key[1], started=seq)

    def close(self) -> None:
        pass


def recent_log(events: DataFrame, most: int = 200) -> DataFrame:
    """The last lines of each run that has new ones, whole each time: for a table whose keys are the runs. Start it within ``keyed_state``."""
    return events.select("run_id", "seq", "type").groupBy("run_id").transformWithState(_LastLines(most), LOG_SCHEMA, "Update", "None")


def pending_timeouts(events: DataFrame, wait_seconds: int = 2 * 3600, late: str = "10 minutes") -> DataFrame:
    """Starts that nothing finished within ``wait_seconds``, given out when the watermark passes that time. Start it within ``keyed_state``.

    A done event finishes all starts of its item in the time before it.
    """
    timed = events.selectExpr("run_id", "item_key", "seq", "type", "ts", "unix_millis(ts) AS at").withWatermark("ts", late)
    return timed.groupBy("run_id", "item_key").transformWithState(_Unfinished(1000 * wait_seconds), PENDING_SCHEMA, "Append", "EventTime")

"""Alerts that need state between windows, on a live stream.

Each takes a stream of rows, closes aligned windows by the watermark (one row
a key and window, however the rows were ordered), and keeps a few numbers of
each key with an event-time timer, so that what doesn't come is noticed too.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from .monitor import late

#: The state store that keyed state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with a state store that stateful alerts can use."""
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.set(STORE[0], before)


class _Keyed(StatefulProcessor):
    """State and one timer a key; a key's rows come in the order of their time."""

    def __init__(self, keys: list[str], fields: str, columns: list[str]):
        self.keys, self.fields, self.columns = keys, fields, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.fields)

    def arm(self, seconds: int) -> None:
        """Replace the key's timer."""
        self.disarm()
        self.handle.registerTimer(seconds * 1000)

    def disarm(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def told(self, key, out: list[tuple]) -> Iterator[Row]:
        # rows, not a table a key: those of many keys travel together
        for r in out:
            yield Row(**dict(zip([*self.keys, *self.columns], (*key, *r))))

    def close(self) -> None:
        pass


class Sustained(_Keyed):
    """Runs of consecutive breaching windows of one key.

    A run that has lasted ``hold`` seconds is told once as "firing", and as
    "ended" when a window doesn't breach, or has not come.
    """

    def __init__(self, keys: list[str], seconds: int, hold: int):
        super().__init__(keys, "since long, until long, windows long", ["state", "since", "until", "windows"])
        self.seconds, self.hold = seconds, hold

    def _ended(self, run) -> list[tuple]:
        return [("ended", *run)] if run and run[2] * self.seconds >= self.hold else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, out = tuple(self.state.get()) if self.state.exists() else None, []
        for t, breach in sorted((r["t"], r["breach"]) for r in rows):
            if breach and run and t == run[1] + self.seconds:
                run = (run[0], t, run[2] + 1)
            else:
                out += self._ended(run)
                run = (t, t, 1) if breach else None
            if run and (run[2] - 1) * self.seconds < self.hold <= run[2] * self.seconds:
                out.append(("firing", *run))
        if run:
            self.state.update(run)
            # the next window, had it come, is closed by then
            self.arm(run[1] + 2 * self.seconds)
        else:
            self.state.clear()
            self.disarm()
        yield from self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run = tuple(self.state.get()) if self.state.exists() else None
        self.state.clear()
        yield from self.told(key, self._ended(run))


class Absence(_Keyed):
    """Windows without any row of a key for ``hold`` seconds.

    A key that has stopped is told once, as "absent", when its timer expires;
    when it comes back the whole gap is told as "returned".
    """

    def __init__(self, keys: list[str], seconds: int, hold: int, began: int | None):
        super().__init__(keys, "last long", ["state", "since", "windows"])
        self.seconds, self.hold, self.began = seconds, hold, began

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, out = self.state.get() if self.state.exists() else None, []
        last = known[0] if known else None
        if known:
            # its only timer, which needn't be looked for
            self.handle.deleteTimer((last + self.seconds + self.hold) * 1000)
        elif self.began is not None:
            last = self.began - self.seconds
        for t in sorted(r["t"] for r in rows):
            if last is not None and t - last - self.seconds >= self.hold:
                out.append(("returned", last + self.seconds, (t - last) // self.seconds - 1))
            last = t
        self.state.update((last,))
        self.handle.registerTimer((last + self.seconds + self.hold) * 1000)
        yield from self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the state stays, and with it the key's last window
        yield from self.told(key, [("absent", self.state.get()[0] + self.seconds, self.hold // self.seconds)])


def _windows(log: DataFrame, seconds: int, by: list[str], aggs: dict[str, Column], ts: str) -> DataFrame:
    """Closed windows: the keys as text, t (start in seconds) and the aggregates."""
    g = late(log, ts).groupBy(F.window(ts, f"{seconds} seconds").alias("_w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(*by, F.unix_timestamp("_w.start").alias("t"), *aggs)


def _kinds(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def sustained_stream(log: DataFrame, aggs: dict[str, Column], breach: Column, seconds: int, hold: int, by: list[str], ts: str = "ts") -> DataFrame:
    """(by, state, since, until, windows) as ``Sustained`` tells them; since and
    until are starts of windows in seconds.  ``breach`` is over ``aggs``."""
    w = _windows(log, seconds, by, aggs, ts).select(*by, "t", F.coalesce(breach, F.lit(False)).alias("breach"))
    schema = _kinds(w, by) + "state string, since long, until long, windows long"
    return w.groupBy(*by).transformWithState(Sustained(by, seconds, hold), schema, "Append", "EventTime")


def absence_stream(log: DataFrame, seconds: int, hold: int, by: list[str], began: int | None = None, ts: str = "ts") -> DataFrame:
    """(by, state, since, windows) as ``Absence`` tells them.  ``began`` is the
    start, in seconds, of the log's first window; without it a key's gaps
    count from its own first row."""
    w = _windows(log, seconds, by, {"n": F.count("*")}, ts).select(*by, "t")
    schema = _kinds(w, by) + "state string, since long, windows long"
    return w.groupBy(*by).transformWithState(Absence(by, seconds, hold, began), schema, "Append", "EventTime")


def sessions(log: DataFrame, gap: str, least: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Sessions of at least ``least`` rows, none of which is ``gap`` or more
    after the one before: (by, since, until, n), of a batch or a stream.

    A session's windows merge in the state store, whatever the order of rows.
    """
    g = late(log, ts).groupBy(F.session_window(ts, gap).alias("_w"), *by).agg(F.count("*").alias("n"), F.min(ts).alias("since"), F.max(ts).alias("until"))
    return g.filter(F.col("n") >= least).select(*by, "since", "until", "n")


def once(stream: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows whose key hasn't come within the watermark; its state counts each row that comes too late."""
    return late(stream, ts).dropDuplicatesWithinWatermark([key])


class LateRows(StreamingQueryListener):
    """Rows that each batch of each query read, and that its watermark dropped.

    The last ``most`` batches are kept on the driver (a few numbers each);
    ``table`` gives them as rows.
    """

    def __init__(self, most: int = 10_000):
        self.most, self.rows = most, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def add(self, progress) -> None:
        dropped = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        # a batch that is run again counts once
        self.rows[str(progress.id), progress.batchId] = (str(progress.id), progress.name, progress.batchId, progress.numInputRows, dropped, progress.eventTime.get("watermark"))
        while len(self.rows) > self.most:
            self.rows.pop(next(iter(self.rows)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows.values()), "query string, name string, batch long, input_rows long, dropped long, watermark string")

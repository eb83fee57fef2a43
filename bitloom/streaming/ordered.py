"""Histories over an unbounded stream whose rows come in any order: each row waits for the ones before it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "history long, t long, total long, change long"
COLUMNS = ["history", "t", "total", "change"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Keeps state in RocksDB, which keyed maps and timers need, for streams that start inside; the setting is put back at the end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Running(StatefulProcessor):
    """State of a history: the next place, the XOR so far and how many rows wait, and rows that wait, by place.

    Each question to the state is a message to the JVM, so none is asked about waiting rows where none waits, and a batch of a
    history reads and writes what it has done so far once.

    * A row whose place is the next goes out with the XOR up to it, and so do the ones that waited for it.
    * A row of a later place waits in state, one entry a row, however far ahead it is.
    * A row of an earlier place, or of one that waits already, is late and counts no more: the first of a place is the one.
    * Where the next place doesn't come for ``patience`` milliseconds (if given), the least one that waits is taken as the next.
    """

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "next long, total long, waiting long")
        self.waits = handle.getMapState("waits", "t long", "f long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_, total, waiting = self.done.get() or (0, 0, 0)
        before = (next_, total, waiting)
        new: dict[int, int] = {}
        for frame in rows:
            for t, f in zip(frame["t"].tolist(), frame["f"].tolist()):
                if t >= next_ and t not in new and not (waiting and self.waits.containsKey((t,))):
                    new[t] = int(f)
        out = []
        for t in sorted(new):
            if t != next_:
                if t > next_:
                    self.waits.updateValue((t,), (new[t],))
                    waiting += 1
                continue
            next_, total, waiting = self._go(key, next_, total, waiting, new[t], out, new)
        if (next_, total, waiting) != before:
            self.done.update((next_, total, waiting))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def _go(self, key, t: int, total: int, waiting: int, f: int, out: list, new: dict[int, int]) -> tuple[int, int, int]:
        """Adds the row of place t and those that follow it, new or waiting, to ``out``; the place after them, the XOR and how many wait."""
        while True:
            out.append((key[0], t, total ^ f, f))  # the change is the row's own value
            total, t = total ^ f, t + 1
            if t in new:
                f = new[t]
            elif waiting and self.waits.containsKey((t,)):
                f = int(self.waits.getValue((t,))[0])
                self.waits.removeKey((t,))
                waiting -= 1
            else:
                return t, total, waiting

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, total, _ = self.done.get() or (0, 0, 0)
        places = [t for (t,) in self.waits.keys()]
        if places:
            least, out = min(places), []
            f = int(self.waits.getValue((least,))[0])
            self.waits.removeKey((least,))
            state = self._go(key, least, total, len(places) - 1, f, out, {})
            self.done.update(state)
            yield pd.DataFrame(out, columns=COLUMNS)
            if state[2]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def running_xor(rounds: DataFrame, patience: int | None = None) -> DataFrame:
    """A stream of (history, t, f) -> (history, t, total, change): the XOR up to each place t = 0, 1, ..., and its change.

    Rows may come in any order and be cut into batches anyhow: what goes out is that of the ordered history.  Rows without a
    history, place or value are left out.  The stream must be started inside ``state_store``.
    """
    whole = rounds.where("history is not null and t is not null and f is not null and t >= 0")
    mode = "None" if patience is None else "ProcessingTime"
    return whole.groupBy("history").transformWithStateInPandas(Running(patience), OUT, "append", mode)

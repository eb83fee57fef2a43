"""Detectors over an unbounded stream of rounds (an extension: finite relations use operators.temporal)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_detectors(rounds: DataFrame) -> DataFrame:
    """A stream of (history, t, f) -> (history, t, total, change): XOR so far, and its change; rounds of a history arrive in order of t within a batch."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        (total,) = state.get if state.exists else (0,)
        for f in frames:
            f = f.sort_values("t")
            rows = []
            for t, x in zip(f["t"], f["f"]):
                before, total = total, total ^ int(x)
                rows.append((key[0], int(t), total, before ^ total))
            yield pd.DataFrame(rows, columns=["history", "t", "total", "change"])
        state.update((total,))

    return rounds.groupBy("history").applyInPandasWithState(step, "history long, t long, total long, change long", "total long", "append", GroupStateTimeout.NoTimeout)

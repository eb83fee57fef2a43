"""Histories from a stream that comes out of order: the same rows whatever the batches; late rows, gaps and patience."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

import bitloom
from bitloom.streaming import ordered

SCHEMA = "history long, t long, f long"


def by_hand(rows):
    first = {}
    for h, t, f in rows:
        first.setdefault((h, t), f)
    out = []
    for h in {h for h, _ in first}:
        total, t = 0, 0
        while (h, t) in first:
            total ^= first[h, t]
            out.append((h, t, total, first[h, t]))
            t += 1
    return sorted(out)


def start(spark, folder, patience=None, **trigger):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return ordered.running_xor(s, patience).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(**trigger).start()


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def got(spark, folder):
    return sorted(tuple(r) for r in spark.read.schema(ordered.OUT).parquet(f"{folder}/out").collect())


def test_any_order_and_any_batches(spark, tmp_path):
    bitloom.ship(spark)
    rng = random.Random(4)
    rows = [(h, t, rng.randint(0, 999)) for h in range(6) for t in range(rng.randint(1, 9))]
    before = spark.conf.get(ordered.PROVIDER, None)
    for cuts in (1, 3):
        folder = f"{tmp_path}/{cuts}"
        rng.shuffle(rows)
        for i in range(cuts):
            put(spark, rows[i::cuts], folder)
        with ordered.state_store(spark):
            start(spark, folder, availableNow=True).awaitTermination()
        assert got(spark, folder) == by_hand(rows)
    # another run takes what is new: late rows count no more, a gap holds later rows back until it is filled
    more = [(0, 0, 5000), (9, 1, 7), (9, 2, 8), (None, 1, 1), (3, None, 1), (3, -1, 1)]
    put(spark, more, folder)
    with ordered.state_store(spark):
        start(spark, folder, availableNow=True).awaitTermination()
    assert got(spark, folder) == by_hand(rows)
    put(spark, [(9, 0, 6), (9, 2, 100)], folder)
    with ordered.state_store(spark):
        start(spark, folder, availableNow=True).awaitTermination()
    assert got(spark, folder) == by_hand([*rows, (9, 0, 6), (9, 1, 7), (9, 2, 8)])
    assert spark.conf.get(ordered.PROVIDER, None) == before


def test_patience_ends_the_wait_for_a_gap(spark, tmp_path):
    bitloom.ship(spark)
    put(spark, [(1, 0, 3), (1, 2, 4), (1, 3, 8), (2, 5, 1)], tmp_path)
    with ordered.state_store(spark):
        q = start(spark, tmp_path, 500, processingTime="300 milliseconds")
        try:
            until = time.time() + 60
            while time.time() < until and q.exception() is None:
                time.sleep(1)
                if (tmp_path / "out").exists() and len(got(spark, tmp_path)) == 4:
                    break
        finally:
            q.stop()
    assert got(spark, tmp_path) == [(1, 0, 3, 3), (1, 2, 7, 4), (1, 3, 15, 8), (2, 5, 1, 1)]
    assert spark.read.schema(ordered.OUT).parquet(f"{tmp_path}/out").where(F.col("history") == 2).count() == 1


class Asked:
    """A state in memory that counts what it is asked."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": lambda k, v: self.map.update({k: v}), "removeKey": lambda k: self.map.pop(k),
        }[name]


def test_state_is_asked_little_where_nothing_waits():
    state, run = Asked(), ordered.Running()
    run.init(state)
    rows = pd.DataFrame({"t": range(100), "f": range(100)})
    out = list(run.handleInputRows((1,), iter([rows]), None))
    assert len(out) == 1 and list(out[0]["t"]) == list(range(100)) and state.calls == 2
    out = list(run.handleInputRows((1,), iter([pd.DataFrame({"t": [101, 103], "f": [5, 6]})]), None))
    assert not out and state.value[2] == 2
    out = list(run.handleInputRows((1,), iter([pd.DataFrame({"t": [100, 101, 102], "f": [1, 9, 2]})]), None))
    assert list(out[0]["change"]) == [1, 5, 2, 6] and state.value[0] == 104 and state.value[2] == 0 and not state.map

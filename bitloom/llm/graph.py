"""Connected components of a distributed edge table (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _directed(e: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller id."""
    e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return e.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(ws: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component), for each node of an edge; component is the smallest node reachable.

    Every round is joins and min-aggregates over written tables: a hub's edges
    are an ordinary skewed join side, which adaptive execution splits, and the
    result is a star at each component's smallest node.
    """
    e = ws.table(_directed(edges), "edges")
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # large star: the larger neighbours of b move to the smallest in b's neighbourhood, which is b's smallest neighbour or b
        low = ws.table(e.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "low")
        large = e.join(low, e.b == low.k, "left").select("a", F.coalesce("m", "b").alias("b"))
        large = ws.table(_directed(large), "large")
        ws.drop(low)
        # small star: a's smaller neighbours, and a, move to the smallest of them
        low = ws.table(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), "low")
        small = large.join(low, large.a == low.k).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = ws.table(_directed(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))), "small")
        ws.drop(low, large, e)
        e, now = small, _mark(small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components didn't settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ws.table(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")

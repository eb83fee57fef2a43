"""Linked records: chains by predecessor, reachability, cycles.  Rounds of joins over written tables, never a walk on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage


def chains(records: DataFrame, own: str, before: str) -> DataFrame:
    """List ranking by pointer doubling.  records (own, before, ...) -> (own, chain, rank, status, successors, copies), a row for each own.

    ``before`` names the record that one follows, null where it begins a chain.  Status:

    * ``chained``: it leads back to a beginning; ``chain`` is that, ``rank`` its place from 1;
    * ``broken``: it leads back to a record whose predecessor isn't there, which is ``chain``, with ``rank`` from 1;
    * ``cycle``: it comes back to itself; ``after cycle``: it leads back to such a record.  Both have no chain and no rank.

    ``successors`` counts the records that name it (more than one is a fork), ``copies`` the rows that hold it; where they name
    different predecessors the least counts.  Rows without ``own`` are left out; an empty table gives an empty result.

    Each round doubles how far every pointer reaches, so a chain of n records takes log2(n) + 1 rounds of one join.  Records
    that have arrived are only looked up from then on.
    """
    stage = Stage(records.sparkSession, "chains")
    r = records.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("own")).agg(F.min(before).alias("before"), F.count("*").alias("copies"))
    r = stage.write(r, "records")
    named = r.where("before is not null").groupBy("before").agg(F.count("*").alias("successors")).withColumnRenamed("before", "name")
    known = r.select(F.col("own").alias("target"), F.lit(True).alias("there"))
    first = r.join(known, r.before == known.target, "left")
    begins = F.col("there").isNull()
    status = F.when(F.col("before").isNull(), "chained").when(begins, "broken")
    state = first.select("own", F.when(begins, F.col("own")).otherwise(F.col("before")).alias("to"), F.when(begins, 0).otherwise(1).cast("long").alias("steps"), status.alias("status"))
    moving = stage.write(state, "state")
    n, reach = r.count(), 1
    done = [stage.write(moving.where("status is not null"), "arrived")]
    moving = stage.write(moving.where("status is null"), "moving")
    # after k rounds a pointer reaches 2**k records; one that hasn't arrived after n steps is on a cycle or leads to it
    while reach < 2 * n and not moving.isEmpty():
        arrived = done[0]
        for more in done[1:]:
            arrived = arrived.unionByName(more)
        at = arrived.unionByName(moving).select(F.col("own").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("status").alias("known"))
        after = moving.join(at, "to").select("own", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("known").alias("status"))
        after = stage.write(after, "state")
        done.append(stage.write(after.where("status is not null"), "arrived"))
        moving = stage.write(after.where("status is null"), "moving")
        reach *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select("own", F.col("to").alias("chain"), (F.col("steps") + 1).alias("rank"), "status")
    # pointers that went round for n steps or more stand on cycles, and on every record of them
    on = moving.select(F.col("to").alias("own")).distinct().withColumn("on", F.lit(True))
    round_ = moving.join(on, "own", "left").select("own", F.lit(None).cast(r.schema["own"].dataType).alias("chain"), F.lit(None).cast("long").alias("rank"), F.when(F.col("on"), "cycle").otherwise("after cycle").alias("status"))
    out = out.unionByName(round_).join(named, F.col("own") == F.col("name"), "left").join(r.select("own", "copies"), "own")
    return out.select("own", "chain", "rank", "status", F.coalesce("successors", F.lit(0)).cast("long").alias("successors"), "copies")


def closure(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Semi-naive transitive closure.  edges (child, parent) -> (changed, affected): all that a change of ``changed`` reaches.

    A parent's change reaches its children; each round joins the pairs that the last one found, and only those, with the edges,
    and leaves out what is known.  Rounds are as many as the longest shortest path; the result may be quadratic in the
    vertices, so start from the ones that matter (``reached``) where that is too much.
    """
    return reached(edges, edges.select(F.col("parent").alias("changed")).distinct(), most_rounds)


def reached(edges: DataFrame, changed: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The pairs of ``closure`` whose first is in changed (changed); a vertex reaches itself only along a cycle."""
    stage = Stage(edges.sparkSession, "closure")
    e = stage.write(edges.where("child is not null and parent is not null").select("child", "parent").distinct(), "edges")
    start = changed.where("changed is not null").select("changed").distinct()
    new = stage.write(start.join(e, F.col("changed") == F.col("parent")).select("changed", F.col("child").alias("affected")), "new")
    known = [new]
    for _ in range(most_rounds):
        if new.isEmpty():
            break
        found = new.join(e, F.col("affected") == F.col("parent")).select("changed", F.col("child").alias("affected")).distinct()
        for k in known:
            found = found.join(k, ["changed", "affected"], "left_anti")
        new = stage.write(found, "new")
        known.append(new)
        if len(known) > 4:  # few tables to look in, the oldest merged
            merged = stage.write(known[0].unionByName(known[1]), "known")
            known = [merged, *known[2:]]
    else:
        raise RuntimeError("closure didn't settle")
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    return out


def spread(stage: Stage, edges: DataFrame, marks: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """marks (v, mark), edges (a, b) -> (v, mark) with the greatest mark among v and all that lead to it along a -> b; only changes travel."""
    now = stage.write(marks, "marks")
    changed = now
    for _ in range(most_rounds):
        sent = changed.join(edges, F.col("v") == F.col("a")).groupBy(F.col("b").alias("v")).agg(F.max("mark").alias("sent"))
        better = stage.write(now.join(sent, "v").where("sent > mark").select("v", F.col("sent").alias("mark")), "better")
        if better.isEmpty():
            return now
        now = stage.write(now.join(better.select("v", F.col("mark").alias("new")), "v", "left").select("v", F.coalesce("new", "mark").alias("mark")), "marks")
        changed = better
    raise RuntimeError("marks didn't settle")


def components(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Strongly connected components.  edges (child, parent) -> (vertex, component, size, cyclic).

    ``component`` is the least vertex of it; ``cyclic`` tells whether it has a cycle: more than one vertex, or an edge to itself.
    Vertices without a way in or out among the rest are set apart first, round by round.  In what is left, each vertex takes the
    greatest vertex that leads to it as its colour, and the vertices of a colour that also lead back to it are a component; the
    others go on.  Every colour gives one component a round.
    """
    stage = Stage(edges.sparkSession, "components")
    e = edges.where("child is not null and parent is not null")
    loops = stage.write(e.where("child = parent").select(F.col("child").alias("v")).distinct(), "loops")
    all_ = stage.write(e.select(F.col("child").alias("v")).union(e.select(F.col("parent").alias("v"))).distinct(), "vertices")
    e = stage.write(e.where("child <> parent").select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct(), "edges")
    done, alone = [], []
    for _ in range(most_rounds):
        while not e.isEmpty():  # vertices that lead nowhere, or that nothing leads to
            both = stage.write(e.select(F.col("a").alias("v")).intersect(e.select(F.col("b").alias("v"))), "inner")
            kept = stage.write(e.join(both.withColumnRenamed("v", "a"), "a", "left_semi").join(both.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"), "edges")
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        if e.isEmpty():
            break
        v = stage.write(e.select(F.col("a").alias("v")).distinct(), "rest")
        colour = spread(stage, e, v.select("v", F.col("v").alias("mark")))
        c = colour.select("v", F.col("mark").alias("c"))
        inner = e.join(c.withColumnsRenamed({"v": "a", "c": "ca"}), "a").join(c.withColumnsRenamed({"v": "b", "c": "cb"}), "b").where("ca = cb")
        back = stage.write(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), "back")
        home = spread(stage, back, c.select("v", F.when(F.col("v") == F.col("c"), 1).otherwise(0).alias("mark")))
        found = stage.write(home.where("mark = 1").join(c, "v").select("v", "c"), "found")
        done.append(found)
        e = stage.write(e.join(found.select(F.col("v").alias("a")), "a", "left_anti").join(found.select(F.col("v").alias("b")), "b", "left_anti"), "edges")
    else:
        raise RuntimeError("components didn't settle")
    if done:
        found = done[0]
        for d in done[1:]:
            found = found.unionByName(d)
        sizes = found.groupBy("c").agg(F.min("v").alias("component"), F.count("*").alias("size"))
        alone = all_.join(found.join(sizes, "c").select("v", "component", "size"), "v", "left")
    else:
        alone = all_.select("v", F.lit(None).cast(all_.schema["v"].dataType).alias("component"), F.lit(None).cast("long").alias("size"))
    out = alone.join(loops.withColumn("loop", F.lit(True)), "v", "left")
    return out.select(F.col("v").alias("vertex"), F.coalesce("component", "v").alias("component"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce(F.col("size") > 1, F.col("loop"), F.lit(False)).alias("cyclic"))

"""Orders over whole tables: running sums, ranks, first crossings, samples by digest, ordered identities.  No task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage


def _offsets(totals: DataFrame, part: str, value: str, group: int = 1024) -> DataFrame:
    """(part, value) -> (part, ahead): sums of the parts before, in two steps, so that a window holds ``group`` parts or one row a group."""
    t = totals.withColumn("__g", F.expr(f"{part} div {group}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    g = t.groupBy("__g").agg(F.sum(value).alias("__n"))
    g = g.select("__g", F.sum("__n").over(before(Window.orderBy("__g"))).alias("__far"))
    t = t.withColumn("__near", F.sum(value).over(before(Window.partitionBy("__g").orderBy(part)))).join(g, "__g")
    zero = F.lit(0).cast(totals.schema[value].dataType)
    return t.select(part, (F.coalesce("__near", zero) + F.coalesce("__far", zero)).alias("ahead"))


def running(rows: DataFrame, order: list[str], value: Column | None = None, parts: int | None = None, stage: Stage | None = None) -> DataFrame:
    """All columns with ``running``, the sum of ``value`` (1: the rank) over the rows up to this one in the given order.

    Rows are dealt to ranges of the order, written, and summed within each range; the sums of the ranges before are added from a
    small table of one row a range.  ``value`` must add up exactly (whole numbers, decimals).  Equal rows of the order
    follow each other in any sequence, so ``order`` should be unique where it matters.  Nulls come first and add nothing.
    """
    stage = stage or Stage(rows.sparkSession, "running")
    value = F.lit(1).cast("long") if value is None else value
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__value", value).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = stage.write(ranged, "ranged")
    totals = stage.write(ranged.groupBy("__part").agg(F.sum("__value").alias("__sum")), "totals")
    ahead = _offsets(totals, "__part", "__sum")
    to_here = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__here", F.sum("__value").over(to_here)).join(ahead, "__part")
    zero = F.lit(0).cast(totals.schema["__sum"].dataType)
    return summed.withColumn("running", F.coalesce("__here", zero) + F.col("ahead")).drop("__here", "__part", "__value", "ahead")


def first_crossings(rows: DataFrame, order: list[str], value: Column, caps: list[int]) -> DataFrame:
    """For each cap that is exceeded the first row in the order at which the running value exceeds it: (cap, order..., running).

    Caps are configuration: each is one least row, taken by all tasks in a single pass and merged.
    """
    summed = running(rows, order, value)
    here = F.struct(*order, "running")
    least = summed.agg(*(F.min(F.when(F.col("running") > cap, here)).alias(f"c{i}") for i, cap in enumerate(caps)))
    each = least.select(F.explode(F.array(*(F.struct(F.lit(cap).cast("long").alias("cap"), F.col(f"c{i}").alias("at")) for i, cap in enumerate(caps)))).alias("x"))
    return each.where("x.at is not null").select("x.cap", "x.at.*")


def digest_sample(keys: DataFrame, key: str, seed: str, k: int) -> DataFrame:
    """(key, draw): the k distinct keys whose digests with the seed are least, in that order.

    The same keys come out whatever the partitioning, and a table that holds only some of them gives the same choice among those
    (samples of two tables agree on common keys).  Tasks keep their own least k, so k rows a task are merged.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    distinct = keys.where(F.col(key).isNotNull()).select(key).distinct()
    return distinct.select(key, digest.alias("draw")).orderBy("draw", key).limit(k)


def tree(files: DataFrame, key: str, digest: str, fan: int = 256) -> DataFrame:
    """(level, node, n, sha): a Merkle tree over ranks of the ordered records.

    Level 0 has a node for each ``fan`` records in order of ``key`` (ties by digest; null keys first), a level above one for
    each ``fan`` nodes, up to the root.  A node's digest is that of its children's, joined by commas; its ``n`` is the number of
    records below it.  A task holds ``fan`` digests at a time.  An empty table has no nodes.
    """
    stage = Stage(files.sparkSession, "tree")
    ranked = running(files.select(F.col(key).alias("__key"), F.col(digest).alias("sha")), ["__key", "sha"], stage=stage)
    rows = ranked.select((F.col("running") - 1).alias("at"), "sha", F.lit(1).cast("long").alias("n"))
    out, level = None, 0
    while True:
        inner = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha"))), lambda x: x["sha"])
        nodes = rows.groupBy(F.expr(f"at div {fan}").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws(",", inner), 256).alias("sha"))
        nodes = stage.write(nodes.select(F.lit(level).alias("level"), "node", "n", "sha"), f"level{level}")
        out = nodes if out is None else out.unionByName(nodes)
        if nodes.count() <= 1:
            return out
        rows, level = nodes.select(F.col("node").alias("at"), "sha", "n"), level + 1


def changed_nodes(one: DataFrame, other: DataFrame) -> DataFrame:
    """(level, node): nodes of two trees that differ or that one lacks; below an equal node nothing can differ, so only these are looked at."""
    a, b = one.select("level", "node", F.col("sha").alias("a")), other.select("level", "node", F.col("sha").alias("b"))
    return a.join(b, ["level", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")


def inclusion(nodes: DataFrame, files: DataFrame, key: str, digest: str, wanted: DataFrame, fan: int = 256) -> DataFrame:
    """Proofs that records are part of a tree: (key, level, place, siblings) for each of wanted (key).

    ``siblings`` are the digests of the node that holds the record (level 0) or the node below (above), in order, ``place`` its
    place among them; hashing them level by level gives the root's digest.
    """
    stage = Stage(files.sparkSession, "proof")
    ranked = running(files.select(F.col(key).alias("__key"), F.col(digest).alias("sha")), ["__key", "sha"], stage=stage)
    ranked = stage.write(ranked.select("__key", (F.col("running") - 1).alias("at"), "sha"), "ranked")
    mine = ranked.join(wanted.select(F.col(key).alias("__key")).distinct(), "__key").select("__key", "at")
    rows, out = ranked.select("at", "sha"), None
    for level in range(nodes.agg(F.max("level")).first()[0] + 1):
        ask = mine.select("__key", F.expr(f"at div {fan}").alias("node"), (F.col("at") % fan).cast("int").alias("place"))
        inner = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha"))), lambda x: x["sha"])
        groups = rows.groupBy(F.expr(f"at div {fan}").alias("node")).agg(inner.alias("siblings"))
        step = ask.join(groups, "node").select(F.col("__key").alias(key), F.lit(level).alias("level"), "place", "siblings")
        out = step if out is None else out.unionByName(step)
        mine = ask.select("__key", F.col("node").alias("at"))
        rows = nodes.where(F.col("level") == level).select(F.col("node").alias("at"), "sha")
    return out

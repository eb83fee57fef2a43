"""Signatures, collisions, coverage, reconciliation: operators over labelled or keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate(name: str, weight: Column, width: int, target: int = 0) -> Column:
    """P02."""
    value = {"or": weight > 0, "majority": weight * 2 > width, "parity": weight % 2 == 1, "exact_weight": weight == target}[name]
    return value.cast("int")


def signal(name: str, weight: Column, width: int) -> Column:
    """P03."""
    w = weight.cast("double")
    return {"hamming_normalized": 2 * w / width - 1, "marked_amplitude": F.sqrt(w / width), "parity_phase": F.when(weight % 2 == 0, 1.0).otherwise(-1.0)}[name]


def collisions(rows: DataFrame, signature: str, label: str, order: str) -> DataFrame:
    """For each signature the number of (zero, one) pairs and the first row of each label; no self-join."""
    zero, one = F.col(label) == 0, F.col(label) == 1
    g = rows.groupBy(signature).agg(F.count_if(zero).alias("zeros"), F.count_if(one).alias("ones"), F.min_by(F.when(zero, F.col(order)), F.when(zero, F.col(order))).alias("zero_first"), F.min_by(F.when(one, F.col(order)), F.when(one, F.col(order))).alias("one_first"))
    return g.withColumn("pairs", F.col("zeros") * F.col("ones"))


def sorted_stretches(rows: DataFrame, signal: str, label: str) -> DataFrame:
    """One row for each range of the sorted distinct values: its ends, and what neighbours in it show.

    (first, first_lo, first_hi, last, last_lo, last_hi, gap, changes, mixed).  Values are range-partitioned, so the
    order costs one shuffle and no task sees all of it; neighbours across ranges are left to the few rows returned.
    """
    import numpy as np
    import pyarrow as pa

    v = rows.groupBy(F.col(signal).cast("double").alias("v")).agg(F.min(label).cast("int").alias("lo"), F.max(label).cast("int").alias("hi"))

    def run(batches):
        first = last = None
        best, changes, mixed = np.inf, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            x, lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if last:
                x, lo, hi = np.append(last[0], x), np.append(last[1], lo), np.append(last[2], hi)
            first = first or (x[0], lo[0], hi[0])
            differ = (lo[1:] != hi[:-1]) | (hi[1:] != lo[:-1])
            best = min(best, np.min((x[1:] - x[:-1])[differ], initial=np.inf))
            changes += int((lo[1:] != lo[:-1]).sum())
            mixed = mixed or bool((lo != hi).any())
            last = (x[-1], lo[-1], hi[-1])
        if first:
            values = [float(first[0]), int(first[1]), int(first[2]), float(last[0]), int(last[1]), int(last[2]), float(best), changes, mixed]
            yield pa.RecordBatch.from_arrays([pa.array([y]) for y in values], ["first", "first_lo", "first_hi", "last", "last_lo", "last_hi", "gap", "changes", "mixed"])

    ranged = v.where("v is not null").repartitionByRange("v").sortWithinPartitions("v")
    kinds = "first double, first_lo long, first_hi long, last double, last_lo long, last_hi long, gap double, changes long, mixed boolean"
    before = Window.orderBy("first")  # one row for each range
    return ranged.mapInArrow(run, kinds).withColumns({c: F.lag(c.removeprefix("before_")).over(before) for c in ("before_last", "before_last_lo", "before_last_hi")})


def gap(rows: DataFrame, signal: str, label: str) -> DataFrame:
    """Least distance between rows of different labels: neighbours in sorted order of the distinct values are enough."""
    s = sorted_stretches(rows, signal, label)
    differ = (F.col("first_lo") != F.col("before_last_hi")) | (F.col("first_hi") != F.col("before_last_lo"))
    across = F.when(differ, F.col("first") - F.col("before_last"))
    found = F.when(F.col("mixed"), 0.0).otherwise(F.least(F.col("gap"), F.coalesce(across, F.lit(float("inf")))))
    return s.agg(F.min(found).alias("gap")).select(F.when(F.col("gap") < float("inf"), F.col("gap")).alias("gap"))


def alternations(rows: DataFrame, signal: str, label: str) -> DataFrame:
    """Label changes along the sorted signal; 0 where one value has both labels."""
    s = sorted_stretches(rows, signal, label)
    n = F.sum(F.col("changes") + F.coalesce((F.col("first_lo") != F.col("before_last_lo")).cast("long"), F.lit(0)))
    return s.agg(F.when(F.bool_or("mixed"), 0).otherwise(n).cast("long").alias("alternations"))


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, unknown and repeated keys."""
    e, o = expected.select(key).distinct(), observed.groupBy(key).agg(F.count("*").alias("n"))
    missing = e.join(o, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unknown = o.join(e, key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    repeated = o.where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return missing.unionByName(unknown).unionByName(repeated)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is absent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owner, owners): rules (prefix, owner) own an exact path or a prefix; the longest wins, ``owners`` counts the different ones.

    A trie as a table: a path meets the rules by hash join on its prefixes, one for each length that rules have, so the work of a
    path is that number, not the number of rules, and neither side is sent whole.  The lengths come to the driver: they are
    different whole numbers up to the longest rule's.  Of rules with one prefix the greatest owner wins; rules without a
    prefix or owner are left out, the empty prefix owns every path; a path that none owns has a null owner; repeated
    paths are one row; a null path is owned by none.
    """
    rules = rules.where("prefix is not null and owner is not null").select("prefix", "owner").distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("prefix")).distinct().collect())
    each = paths.select("path").distinct()
    places = F.array(*map(F.lit, lengths)).cast("array<int>")
    pieces = F.transform(F.filter(places, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    cut = each.select("path", F.explode_outer(pieces).alias("prefix"))
    hit = cut.join(rules.hint("merge"), "prefix", "left").where("owner is not null")
    best = hit.groupBy("path").agg(F.max_by("owner", F.struct(F.length("prefix"), F.col("owner"))).alias("owner"), F.count_distinct("owner").alias("owners"))
    found = each.join(best.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left")
    return found.select("path", "owner", F.coalesce("owners", F.lit(0)).cast("long").alias("owners"))


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def running_xor(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Running XOR within a history, and the change of the XOR from round to round."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("total", F.bit_xor(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("change", F.col("total").bitwiseXOR(F.coalesce(F.lag("total").over(w), F.lit(0).cast("long"))))


def first_crossing(rows: DataFrame, order: str, cost: str, cap: int) -> DataFrame:
    """Running cost, and the first step at which it exceeds the cap."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("running", F.sum(cost).over(w))
    return r.agg(F.min(F.when(F.col("running") > cap, F.col(order))).alias("first_step"), F.max("running").alias("total"))

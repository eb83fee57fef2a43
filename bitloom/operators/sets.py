"""Sets and bit masks as rows: containment joins by the rarest element, bases of XOR spaces that merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stage import Stage


def containing(sets: DataFrame, key: str, items: str) -> DataFrame:
    """Sets (key, items array) -> (key, maximal, smallest): is no other set a proper superset, and which is the smallest that holds it.

    ``smallest`` is, of the proper supersets, the one with fewest items, then the least key (null for maximal sets).  Equal sets
    are one candidate, named by its least key, and don't hide each other.  Repeated items count once, null items are left
    out; an empty set is held by every other set; a null set is empty.

    A set can only lie in sets that hold its rarest item, so it asks the sets of that item alone, and those by size: a superset has
    more items.  An item is looked up where it is rarest, so its popularity as such costs nothing; what is joined is,
    for each item, (sets it is the rarest of) x (sets that hold it).  Adaptive execution splits an item with many.
    """
    stage = Stage(sets.sparkSession, "containing")
    plain = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array().cast(sets.schema[items].dataType)))))
    all_ = stage.write(sets.select(F.col(key).alias("key"), plain.alias("items")), "sets")
    one = stage.write(all_.groupBy("items").agg(F.min("key").alias("name")).withColumn("size", F.size("items")), "distinct")
    member = one.select("name", "size", "items", F.explode("items").alias("item"))
    often = stage.write(member.groupBy("item").agg(F.count("*").alias("often")), "often")
    rarest = member.join(often, "item").groupBy("name").agg(F.min_by("item", F.struct("often", "item")).alias("item"))
    ask = one.join(rarest, "name").select("item", "name", "size", "items")
    holds = member.select("item", F.col("name").alias("super"), F.col("size").alias("super_size"), F.col("items").alias("super_items"))
    meet = ask.join(holds, "item").where((F.col("super_size") > F.col("size")) & (F.size(F.array_except("items", "super_items")) == 0))
    best = meet.groupBy("name").agg(F.min(F.struct("super_size", "super")).alias("best"))
    empty = one.where("size = 0").select("name")
    least = one.where("size > 0").agg(F.min(F.struct("size", "name")).alias("x")).where("x is not null").select(F.struct(F.col("x.size").alias("super_size"), F.col("x.name").alias("super")).alias("best"))
    best = stage.write(best.unionByName(empty.crossJoin(least).select("name", "best")), "best")  # one empty set, one smallest
    out = all_.join(one.select("items", "name"), "items").join(best, "name", "left")
    return out.select(F.col("key").alias(key), F.col("best").isNull().alias("maximal"), F.col("best.super").alias("smallest"))


def _first_independent(batches, of: list[str]):
    """Rows, in order, that no earlier rows' masks add up to (XOR); numpy reduces a batch by one basis mask at a time."""
    import pyarrow as pa

    basis: dict[int, np.uint64] = {}  # leading bit -> mask
    for b in batches:
        if not b.num_rows or len(basis) == 64:
            continue
        masks = b.column(b.schema.get_field_index(of[-1])).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).copy()
        for bit in sorted(basis, reverse=True):
            has = (masks >> np.uint64(bit)) & np.uint64(1) == 1
            masks[has] ^= basis[bit]
        kept = []
        while (left := np.flatnonzero(masks)).size:
            first = int(left[0])
            mask = masks[first]
            bit = int(mask).bit_length() - 1
            basis[bit] = mask
            kept.append(first)
            has = (masks >> np.uint64(bit)) & np.uint64(1) == 1
            masks[has] ^= mask
            # what was reduced by smaller leading bits may have them again
            for lower in sorted((x for x in basis if x < bit), reverse=True):
                again = (masks >> np.uint64(lower)) & np.uint64(1) == 1
                masks[again] ^= basis[lower]
        if kept:
            yield b.take(pa.array(kept))


def independent_rows(rows: DataFrame, order: list[str], mask: str, fan: int = 32) -> DataFrame:
    """(order..., mask): the first rows, in the order, whose 64-bit masks are independent over GF(2); their number is the rank.

    Each task keeps its own first independent rows, at most 64, and so does each merge of ``fan`` tasks: a row that earlier rows
    of its task add up to can't be among the first of all.  Nulls and zero masks are never among them; an empty table has none.
    """
    stage = Stage(rows.sparkSession, "independent")
    columns = [*order, mask]
    schema = rows.select(*columns).schema
    found = rows.where(F.col(mask) != 0).select(*columns).sortWithinPartitions(*order, mask).mapInArrow(lambda b: _first_independent(b, columns), schema)
    found = stage.write(found.withColumn("__part", F.spark_partition_id()), "tasks")
    while found.select("__part").distinct().limit(2).count() > 1:
        groups = found.withColumn("__part", F.expr(f"__part div {fan}").cast("int"))
        merged = groups.groupBy("__part").applyInArrow(lambda key, t: _merge(key, t, columns), T.StructType([*schema, T.StructField("__part", T.IntegerType())]))
        found = stage.write(merged, "merged")
    return found.select(*columns)


def _merge(key, t, columns: list[str]):
    """A group's rows of some tasks (at most 64 each) -> its first independent rows, with the group's number."""
    import pyarrow as pa

    t = t.select(columns).combine_chunks().sort_by([(c, "ascending") for c in columns])
    kept = pa.Table.from_batches(list(_first_independent(t.to_batches(), columns)), t.schema)
    return kept.append_column("__part", pa.array([key[0].as_py()] * kept.num_rows, pa.int32()))


def echelon(masks: list[int]) -> list[int]:
    """Masks of distinct leading bits that span the same space, greatest first; at most 64 go in."""
    out: list[int] = []
    for m in masks:
        m &= (1 << 64) - 1
        for x in out:
            m = min(m, m ^ x)
        if m:
            out = sorted([*out, m], reverse=True)
    return out


def in_span(mask: Column, basis: list[int]) -> Column:
    """Whether masks of a basis (see ``echelon``) add up to a mask; a fold in the JVM over at most 64 entries."""
    signed = [x - (1 << 64) if x >> 63 else x for x in basis]
    steps = F.array(*(F.struct(F.lit(x.bit_length() - 1).alias("bit"), F.lit(s).cast("long").alias("mask")) for x, s in zip(basis, signed)))
    if not basis:
        return mask == 0
    left = F.aggregate(steps, mask.cast("long"), lambda acc, s: F.when(F.call_function("getbit", acc, s["bit"]) == 1, acc.bitwiseXOR(s["mask"])).otherwise(acc))
    return left == 0

"""Coset classes, decisions and scores of decoders over finite corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.codes import CHECKS_18, LOGICALS_18

#: Column of the score, and whether the largest or the smallest wins.
ALGEBRAS = {"sum_product": ("m9", True), "soft_tropical": ("m2", True), "min_plus": ("w", False)}


def classes(states: DataFrame) -> DataFrame:
    """One row for each (syndrome, label), with all semiring aggregates; the two minima are independent."""
    best = F.min(F.struct("w", "e"))
    return states.groupBy("syn", "lab").agg(F.sum("m9").alias("m9"), F.sum("m2").alias("m2"), best["w"].alias("w"), best["e"].alias("rep"), F.min("e").alias("key"), F.count("*").alias("n"))


def winners(classes: DataFrame, algebra: str) -> DataFrame:
    """The best classes of each syndrome, all ties kept."""
    score, largest = ALGEBRAS[algebra]
    best = (F.max if largest else F.min)(score).over(Window.partitionBy("syn"))
    return classes.withColumn("best", best).where(F.col(score) == F.col("best")).drop("best")


def decisions(classes: DataFrame, algebra: str) -> DataFrame:
    """Best class of each syndrome, the lowest key among ties; its representative is the correction."""
    score, largest = ALGEBRAS[algebra]
    order = Window.partitionBy("syn").orderBy(F.col(score).desc() if largest else F.col(score).asc(), "key")
    ranked = classes.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return ranked.select("syn", F.col("rep").alias("correction"), F.col("lab").alias("winner"), F.col("key"))


def lookup(corpus: DataFrame, table: DataFrame, checks=None, logicals=None) -> DataFrame:
    """Corrections by syndrome, and whether the residual is a stabilizer.

    The table has a row for each syndrome, which bounds it; it is sent to the corpus while small.
    """
    checks, logicals = checks or CHECKS_18, logicals or LOGICALS_18
    c = corpus.withColumn("syn", bits.syndrome("e", checks))
    joined = c.join(table.select("syn", "correction"), "syn")
    residual = F.col("e").bitwiseXOR(F.col("correction"))
    consistent = bits.syndrome(residual, checks) == 0
    return joined.withColumn("consistent", consistent).withColumn("success", consistent & (bits.syndrome(residual, logicals) == 0))


def shells(outcomes: DataFrame) -> DataFrame:
    """Successes and failures by weight."""
    return outcomes.groupBy("w").agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failure"))


def marginals(states: DataFrame, width: int = 18) -> DataFrame:
    """For each syndrome the coordinatewise hard decisions of the three algebras, zero on ties (D03's tables)."""
    bit = lambda q: F.shiftright("e", q).bitwiseAND(F.lit(1).cast("long")) == 1
    aggregates = []
    for q in range(width):
        for name, score in (("s", "m9"), ("t", "m2")):
            aggregates += [F.sum(F.when(bit(q), F.col(score))).alias(f"{name}{q}_1"), F.sum(F.when(~bit(q), F.col(score))).alias(f"{name}{q}_0")]
        aggregates += [F.min(F.when(bit(q), F.col("w"))).alias(f"w{q}_1"), F.min(F.when(~bit(q), F.col("w"))).alias(f"w{q}_0")]
    g = states.groupBy("syn").agg(*aggregates)

    def hard(name: str, larger: bool) -> Column:
        def one(q: int) -> Column:
            a, b = F.col(f"{name}{q}_1"), F.col(f"{name}{q}_0")
            wins = a > b if larger else a < b
            return F.when(F.coalesce(wins, a.isNotNull()), F.lit(1 << q).cast("long")).otherwise(F.lit(0).cast("long"))

        return reduce(lambda x, y: x.bitwiseOR(y), [one(q) for q in range(width)])

    return g.select("syn", hard("s", True).alias("sum_product"), hard("t", True).alias("soft_tropical"), hard("w", False).alias("min_plus"))


def leaders(states: DataFrame, width: int = 18) -> DataFrame:
    """Lightest error of each syndrome, the first in combination order among equals."""
    first = F.min_by("e", F.struct(F.col("w"), F.translate(bits.encode("e", width), "01", "10")))
    return states.groupBy("syn").agg(first.alias("correction"), F.min("w").alias("w"))


def distance(states: DataFrame) -> DataFrame:
    """Least weight of an undetected error outside the stabilizers, and how many have it."""
    logical = states.where("syn = 0 and lab <> 0")
    least = logical.groupBy("w").agg(F.count("*").alias("n"))
    return least.orderBy("w").limit(1).select(F.col("w").alias("distance"), F.col("n").alias("multiplicity"))


def envelope(corpus: DataFrame, classes: DataFrame, algebra: str) -> DataFrame:
    """A10: least, greatest and default number of successes over all ways to break ties."""
    hits = corpus.withColumn("syn", bits.syndrome("e", CHECKS_18)).withColumn("lab", bits.syndrome("e", LOGICALS_18)).groupBy("syn", "lab").agg(F.count("*").alias("hits"))
    w = winners(classes, algebra).join(hits, ["syn", "lab"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    by = w.groupBy("syn").agg(F.min("hits").alias("low"), F.max("hits").alias("high"), F.min_by("hits", "key").alias("default"))
    return by.agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("default").alias("chosen"))


def greedy(corpus: DataFrame, checks=None, width: int = 18, limit: int = 18) -> DataFrame:
    """Flips the coordinate that clears most check bits (lowest on ties) until none clears any.

    A fold over at most ``limit`` steps in one expression: no join, no loop of jobs.
    """
    checks = checks or CHECKS_18
    columns = [sum((r >> q & 1) << i for i, r in enumerate(checks)) for q in range(width)]
    one = F.lit(1).cast("long")
    start = F.struct(bits.syndrome("e", checks).alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("steps"), F.lit(0).alias("looks"), F.lit(False).alias("stuck"))

    def step(s: Column, _: Column) -> Column:
        # largest reduction first, then lowest coordinate: one number orders both
        gains = [(bits.weight(s["r"]) - bits.weight(s["r"].bitwiseXOR(F.lit(m).cast("long")))) * 64 + (63 - q) for q, m in enumerate(columns)]
        best = F.greatest(*gains)
        q = 63 - F.pmod(best, F.lit(64))
        useful, live = best >= 64, (s["r"] != 0) & ~s["stuck"]
        column = F.element_at(F.array(*[F.lit(m).cast("long") for m in columns]), q.cast("int") + 1)
        return F.struct(
            F.when(live & useful, s["r"].bitwiseXOR(column)).otherwise(s["r"]).alias("r"),
            F.when(live & useful, s["c"].bitwiseXOR(F.call_function("shiftleft", one, q.cast("int")))).otherwise(s["c"]).alias("c"),
            (s["steps"] + (live & useful).cast("int")).alias("steps"),
            (s["looks"] + live.cast("int") * width).alias("looks"),
            (s["stuck"] | (live & ~useful)).alias("stuck"),
        )

    state = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step)
    out = corpus.withColumn("s", state)
    residual = F.col("e").bitwiseXOR(F.col("s.c"))
    success = (F.col("s.r") == 0) & (bits.syndrome(residual, LOGICALS_18) == 0)
    return out.select(*corpus.columns, F.col("s.c").alias("correction"), (F.col("s.r") != 0).alias("stalled"), F.col("s.steps").alias("iterations"), F.col("s.looks").alias("comparisons"), success.alias("success"))


def compare(a: DataFrame, b: DataFrame, on: str = "idx") -> DataFrame:
    """Paired outcomes; rows whose outcome is unknown on a side don't count."""
    pair = a.select(on, F.col("success").alias("x")).join(b.select(on, F.col("success").alias("y")), on).where("x is not null and y is not null")
    return pair.agg(F.count_if(F.expr("y and not x")).alias("repaired"), F.count_if(F.expr("x and not y")).alias("broken"), F.count_if(F.expr("x = y")).alias("same"), F.count("*").alias("compared"))


def transfer(spark, width: int = 18, checks=None, logicals=None, block: int = 3) -> DataFrame:
    """The same classes by dynamic programming over coordinates: states with one selector merge after each block.

    (syn, lab, m9, m2, w, rep, key): a state's partial masses are multiplied by those of a block's choices; the table never
    exceeds 2**rank rows, and a block costs one shuffle of at most 2**block times that.
    """
    checks, logicals = checks or CHECKS_18, logicals or LOGICALS_18
    rows = [*checks, *logicals]
    columns = [sum((r >> q & 1) << i for i, r in enumerate(rows)) for q in range(width)]
    one = lambda n: F.lit(n).cast("long")
    s = spark.range(1).select(one(0).alias("sel"), one(1).alias("m9"), one(1).alias("m2"), F.struct(F.lit(0).alias("w"), one(0).alias("e")).alias("best"), one(0).alias("key"))
    for start in range(0, width, block):
        span = range(start, min(start + block, width))
        choices = []
        for x in range(1 << len(span)):
            chosen = [q for i, q in enumerate(span) if x >> i & 1]
            flips = reduce(lambda a, q: a ^ columns[q], chosen, 0)
            stay = len(span) - len(chosen)
            choices.append(F.struct(one(flips).alias("flips"), one(9**stay).alias("m9"), one(2**stay).alias("m2"), F.lit(len(chosen)).alias("w"), one(sum(1 << q for q in chosen)).alias("e")))
        s = s.withColumn("o", F.explode(F.array(*choices)))
        best = F.struct((F.col("best.w") + F.col("o.w")).alias("w"), (F.col("best.e") + F.col("o.e")).alias("e"))
        s = s.select(F.col("sel").bitwiseXOR(F.col("o.flips")).alias("sel"), (F.col("m9") * F.col("o.m9")).alias("m9"), (F.col("m2") * F.col("o.m2")).alias("m2"), best.alias("best"), (F.col("key") + F.col("o.e")).alias("key"))
        s = s.groupBy("sel").agg(F.sum("m9").alias("m9"), F.sum("m2").alias("m2"), F.min("best").alias("best"), F.min("key").alias("key"))
    n = len(checks)
    return s.select(F.col("sel").bitwiseAND(one((1 << n) - 1)).alias("syn"), F.shiftright("sel", n).alias("lab"), "m9", "m2", F.col("best.w").alias("w"), F.col("best.e").alias("rep"), "key")

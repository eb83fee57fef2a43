"""Generated relations: domains, state spaces, corpora.  Every relation carries an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.codes import CHECKS_18, LOGICALS_18

#: floor(2**64 / 10) as sixteen hexadecimal digits: a bit is set where the digest's first digits are below.
TENTH = "1999999999999999"


def domain(spark: SparkSession, width: int, weights: list[int] | None = None) -> DataFrame:
    """(ord, input, weight); inputs are most-significant-first strings, optionally only of the given weights."""
    d = spark.range(1 << width).select(F.col("id").alias("ord"), F.lpad(F.bin("id"), width, "0").alias("input"), bits.weight("id").alias("weight"))
    return d if weights is None else d.where(F.col("weight").isin(weights))


def states(spark: SparkSession, width: int = 18, checks: list[int] | None = None, logicals: list[int] | None = None) -> DataFrame:
    """S02 with P07-P09: every error with its weight, syndrome, logical label and exact masses."""
    checks, logicals = checks or CHECKS_18, logicals or LOGICALS_18
    e = spark.range(1 << width).select(F.col("id").alias("e"), bits.weight("id").alias("w"))
    return e.select("e", "w", bits.syndrome("e", checks).alias("syn"), bits.syndrome("e", logicals).alias("lab"), bits.power_of(9, width - F.col("w"), width).alias("m9"), bits.power_of(2, width - F.col("w"), width).alias("m2"))


def weight_shells(spark: SparkSession, width: int = 18, most: int = 4) -> DataFrame:
    """(idx, e, w) of all errors up to a weight, by weight and then combination order."""
    e = spark.range(1 << width).select(F.col("id").alias("e"), bits.weight("id").alias("w")).where(F.col("w") <= most)
    order = Window.orderBy("w", bits.combination_order("e", width).desc())
    return e.withColumn("idx", F.row_number().over(order) - 1)


def fault_histories(spark: SparkSession, width: int = 75) -> DataFrame:
    """(idx, a, b, fault_weight): no fault, each single fault, each pair; absent places are null."""
    p = spark.range(width).select(F.col("id").cast("int").alias("a"))
    single = p.select("a", F.lit(None).cast("int").alias("b"))
    pair = p.join(p.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    none = spark.range(1).select(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    every = none.unionByName(single).unionByName(pair)
    every = every.withColumn("fault_weight", F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int"))
    return every.withColumn("idx", F.row_number().over(Window.orderBy("fault_weight", "a", "b")) - 1)


def big_endian(x: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(x), 2 * size, "0"))


def first_draws(draws, wanted: int, possible: int) -> DataFrame:
    """The first ``wanted`` of the accepted draws, with their rank; ``draws(n)`` gives the accepted ones among n, and n doubles until they are enough."""
    if wanted > possible:
        raise ValueError(f"only {possible} different draws can be accepted")
    tried = 2 * wanted
    while True:
        found = draws(tried).withColumn("nth", F.row_number().over(Window.orderBy("counter"))).where(F.col("nth") <= wanted)
        if found.count() == wanted:
            return found
        tried *= 2


def noise_corpus(spark: SparkSession, width: int, seed: str, accepted: int = 256) -> DataFrame:
    """(idx, role, weight, error): zero, units, then seeded draws; zero, units and repeats are rejected."""
    first = first_draws(lambda tried: noise_draws(spark, width, seed, tried), accepted, 2**width - width - 1)
    zero = F.repeat(F.lit("0"), width)
    unit = F.concat(F.repeat(F.lit("0"), F.col("id").cast("int")), F.lit("1"), F.repeat(F.lit("0"), F.lit(width - 1) - F.col("id").cast("int")))
    units = spark.range(width).select((F.col("id") + 1).cast("int").alias("idx"), F.lit("unit").alias("role"), F.lit(1).alias("weight"), unit.alias("error"))
    rows = spark.range(1).select(F.lit(0).alias("idx"), F.lit("zero").alias("role"), F.lit(0).alias("weight"), zero.alias("error"))
    drawn = first.select((F.col("nth") + width).alias("idx"), F.lit("bsc_p_0_1").alias("role"), F.col("weight"), "error")
    return rows.unionByName(units).unionByName(drawn)


def noise_draws(spark: SparkSession, width: int, seed: str, tried: int) -> DataFrame:
    """(error, counter, weight) of the different errors of weight above one among the first draws."""
    at = spark.range(tried).select(F.col("id").alias("counter")).crossJoin(spark.range(width).select(F.col("id").alias("c")))
    h = F.substring(F.sha2(F.concat(F.encode(F.lit(seed), "US-ASCII"), big_endian(F.col("counter"), 8), big_endian(F.col("c"), 4)), 256), 1, 16)
    drawn = at.select("counter", "c", F.when(h < TENTH, "1").otherwise("0").alias("bit"))
    drawn = drawn.groupBy("counter").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("c", "bit"))), lambda x: x["bit"])).alias("error"))
    drawn = drawn.withColumn("weight", F.length(F.replace("error", F.lit("0"), F.lit("")))).where("weight > 1")
    return drawn.groupBy("error").agg(F.min("counter").alias("counter"), F.first("weight").alias("weight"))


def selector_sample(spark: SparkSession, rank: int, seed: str, drawn: int = 256) -> DataFrame:
    """(idx, coordinate): zero, units, all ones, then seeded draws that aren't reserved or repeated."""
    d = first_draws(lambda tried: selector_draws(spark, rank, seed, tried), drawn, 2**rank - rank - 2)
    reserved = spark.range(rank + 2).select(
        F.col("id").cast("int").alias("idx"),
        F.when(F.col("id") == 0, F.lit(0).cast("long")).when(F.col("id") == rank + 1, F.lit((1 << rank) - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") - 1).cast("int"))).alias("coordinate"),
    )
    return reserved.unionByName(d.select((F.col("nth") + rank + 1).cast("int").alias("idx"), "coordinate"))


def selector_draws(spark: SparkSession, rank: int, seed: str, tried: int) -> DataFrame:
    """(coordinate, counter) of the different coordinates that aren't reserved among the first draws."""
    digest = F.sha2(F.concat(F.encode(F.lit(seed), "US-ASCII"), big_endian(F.col("id"), 8)), 256)
    # the digest's first bit is coordinate 0
    text = F.substring(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(-(-rank // 32))]), 1, rank)
    d = spark.range(tried).select("id", bits.decode(text).alias("coordinate"))
    d = d.where((F.bit_count("coordinate") > 1) & (F.col("coordinate") != (1 << rank) - 1))
    return d.groupBy("coordinate").agg(F.min("id").alias("counter"))

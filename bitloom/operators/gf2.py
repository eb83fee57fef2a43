"""GF(2) matrices as coordinate tables (n, side, r, c) of ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import LADDER


def ladder(spark: SparkSession, codes=LADDER) -> DataFrame:
    return spark.createDataFrame([(n, l, m, list(a), list(b)) for n, l, m, a, b in codes], "n int, l int, m int, a array<int>, b array<int>")


def shift(spark: SparkSession, n: int, by: int) -> DataFrame:
    """A cyclic shift of n coordinates."""
    return spark.range(n).select(F.col("id").alias("r"), F.pmod(F.col("id") + by, F.lit(n)).alias("c"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(*[c for c in m.columns if c not in ("r", "c")], F.col("c").alias("r"), F.col("r").alias("c"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product modulo 2: an odd number of meeting inner indices."""
    met = a.alias("a").join(b.alias("b"), F.col("a.c") == F.col("b.r"))
    return met.groupBy(F.col("a.r").alias("r"), F.col("b.c").alias("c")).agg(F.count("*").alias("n")).where("n % 2 = 1").select("r", "c")


def total(*parts: DataFrame) -> DataFrame:
    """Sum modulo 2."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("r", "c").agg(F.count("*").alias("n")).where("n % 2 = 1").select("r", "c")


def identity(spark: SparkSession, n: int) -> DataFrame:
    """L01."""
    return shift(spark, n, 0)


def power(spark: SparkSession, m: DataFrame, n: int, exponent: int) -> DataFrame:
    """A power of an n x n matrix modulo 2, by repeated squaring."""
    out = identity(spark, n)
    while exponent:
        if exponent & 1:
            out = product(out, m)
        exponent >>= 1
        if exponent:
            m = product(m, m)
    return out


def kronecker(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    """The Kronecker product; ``rows`` and ``columns`` are b's.  As large as its result: each one of a meets each of b."""
    pairs = a.alias("a").join(b.alias("b"))
    return pairs.select((F.col("a.r") * rows + F.col("b.r")).alias("r"), (F.col("a.c") * columns + F.col("b.c")).alias("c"))


def supports(h: DataFrame) -> DataFrame:
    """(n, side, rows, ones, support, sha256): each matrix as a record, with the digest of its canonical text."""
    lines = h.groupBy("n", "side", "r").agg(F.array_sort(F.collect_list("c")).alias("c"))
    one = lines.groupBy("n", "side").agg(F.count("*").alias("rows"), F.sum(F.size("c")).cast("long").alias("ones"), F.array_sort(F.collect_list(F.struct("r", "c"))).alias("lines"))
    text = F.to_json(F.transform("lines", lambda x: x["c"]))
    return one.select("n", "side", "rows", "ones", text.alias("support"), F.sha2(text, 256).alias("sha256"))


def check_matrices(spark: SparkSession, codes=LADDER) -> DataFrame:
    """(n, side, r, c) of H_x and H_z of all codes, from their parameters."""
    g = ladder(spark, codes).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("l") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    at = lambda i, j: F.pmod(i, F.col("l")) * F.col("m") + F.pmod(j, F.col("m"))
    e = lambda name, k: F.element_at(name, k + 1)
    i, j, half = F.col("i"), F.col("j"), F.col("l") * F.col("m")
    left = [at(i + e("a", 0), j), at(i, j + e("a", 1)), at(i, j + e("a", 2))]
    right = [at(i, j + e("b", 0)), at(i + e("b", 1), j), at(i + e("b", 2), j)]
    left_t = [at(i, j - e("b", 0)), at(i - e("b", 1), j), at(i - e("b", 2), j)]
    right_t = [at(i - e("a", 0), j), at(i, j - e("a", 1)), at(i, j - e("a", 2))]
    cols = lambda a, b: F.explode(F.array(*a, *[x + half for x in b]))
    row = at(i, j)
    x = g.select("n", F.lit("x").alias("side"), row.alias("r"), cols(left, right).alias("c"))
    z = g.select("n", F.lit("z").alias("side"), row.alias("r"), cols(left_t, right_t).alias("c"))
    return x.unionByName(z)


def odd_overlaps(h: DataFrame) -> DataFrame:
    """For each code, pairs of X and Z checks, and how many overlap in an odd number of coordinates."""
    x, z = h.where("side = 'x'").alias("x"), h.where("side = 'z'").alias("z")
    met = x.join(z, (F.col("x.n") == F.col("z.n")) & (F.col("x.c") == F.col("z.c")))
    pairs = met.groupBy(F.col("x.n").alias("n"), F.col("x.r").alias("xr"), F.col("z.r").alias("zr")).agg(F.count("*").alias("k"))
    return pairs.groupBy("n").agg(F.count("*").alias("overlapping"), F.count_if(F.expr("k % 2 = 1")).alias("odd"))

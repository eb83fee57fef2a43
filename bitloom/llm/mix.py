"""Mixing sources to target weights by systematic sampling [native].

DataFrame functions only.  Three tables flow: documents reduced to
(doc_id, source, size), strata of at most ``stratum`` rows each, and sources.

* Targets: sources in code-point order (null last) weigh ``weights`` in turn
  and share ``share`` of all words.  A target stops at ``cap`` times its
  source's size; the excess goes to the others by weight.  The level at which
  that stops rises round by round: sources below it are full, and what they
  leave goes to the rest, until no further source is full.
* Sampling: within a source every document expects target/size copies.  Its
  place among its source's documents, ordered by size, is a prefix sum that is
  taken in steps (blocks of strata, strata, rows of a stratum), so a source with
  a third of all rows is never in one task.  With one offset per source, a
  document is taken once per integer boundary its interval crosses.  Ordering by
  size spreads the taken documents evenly over short and long ones, which keeps
  the taken words near the target.
* Strata follow a hash of the id.  Where ids repeat or are null and a stratum has
  over four times its rows, it is split by a hash of the content, and copies of
  one row beyond a stratum's size by their numbers: they are all alike.

Edge cases: null text has size 0 and takes 0 words; a null source is a source
of its own; null ids are kept as rows; rows with one id are ordered by their
content, so reruns agree on them too; repeated rows are sampled one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, read

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sorts as the size does; eight classes for each doubling."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 1, 4), 4, "0"))


def hash32(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(ws: Workspace, sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """(source, source_size) -> also target, copies (per document), start (offset in [0, 1)).

    Sources are numbered by range (a task sorts a range, and the numbers of rows before it are added), so there may be many.
    """
    order = F.col("source").asc_nulls_last()
    s = sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("slice", F.spark_partition_id())
    s = ws.table(s, "sources")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    slices = s.groupBy("slice").agg(F.count("*").alias("n")).select("slice", ahead.alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("slice").orderBy(order)) - 1
    s = s.withColumn("nth", nth).join(slices, "slice")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("ahead") + F.col("nth")) % len(weights) + 1).cast("int"))
    s = ws.table(s.select("source", "source_size", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("limit")), "weights")
    words, rate, full = None, 0.0, -1
    while True:
        open_ = ~(F.col("limit") < F.lit(rate) * F.col("weight"))
        found = s.agg(F.sum("source_size").alias("size"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.sum(F.when(~open_, F.col("limit"))).alias("limit"), F.count(F.when(~open_, 1)).alias("full")).first()
        words = share * (found["size"] or 0)
        if found["full"] == full or not found["weight"]:
            break
        full, rate = found["full"], (words - (found["limit"] or 0.0)) / found["weight"]
    target = F.least("limit", F.lit(rate) * F.col("weight")) if found["weight"] else F.col("limit")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = hash32(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))) / F.lit(float(1 << 32))
    return s.withColumn("target", target).select("source", "source_size", "target", copies.alias("copies"), start.alias("start"))


STRATUM = ("class", "part", "giant", "sub")


def same(a: str, b: str, *columns: str) -> Column:
    on = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for c in columns:
        on &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return on


def split(ws: Workspace, rows: DataFrame, stratum: int) -> DataFrame:
    """rows with sub and giant: both 0, but in parts that one id fills."""
    plain = rows.withColumn("giant", F.lit(0).cast("long")).withColumn("sub", F.lit(0).cast("long"))
    hot = rows.groupBy("source", "class", "part").agg(F.count("*").alias("n")).where(F.col("n") > 4 * stratum)
    hot = ws.table(hot, "hot")
    if hot.isEmpty():
        return plain
    content = ("class", "part", "size", "key", "tie")
    within = rows.alias("r").join(hot.alias("h"), same("r", "h", "class", "part"))
    copies = within.select(F.col("r.source").alias("source"), *[F.col(f"r.{c}").alias(c) for c in content]).groupBy("source", *content).agg(F.count("*").alias("copies")).where(F.col("copies") > stratum)
    copies = ws.table(copies, "copies")
    out = rows.alias("r").join(hot.alias("h"), same("r", "h", "class", "part"), "left").join(copies.alias("c"), same("r", "c", *content), "left")
    giant = F.when(F.col("copies").isNotNull(), F.col("r.tie").bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))  # never 0 for a giant
    slices = lambda n: F.ceil(F.col(n) / stratum).cast("long")
    sub = F.when(F.col("copies").isNotNull(), F.pmod(F.col("r.row"), slices("copies"))).when(F.col("h.n").isNotNull(), F.pmod(F.col("r.tie"), slices("h.n"))).otherwise(F.lit(0).cast("long"))
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in rows.columns], giant.alias("giant"), sub.alias("sub"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, stratum: int = 4096, seed: str = "mix", broadcast_sources: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, copies_taken, taken, and the columns to carry, renamed carry_0, carry_1 ..."""
    ws = Workspace(docs.sparkSession, "mix")
    more = [f"carry_{i}" for i in range(len(carry))]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in {"doc_id", "text", *carry} and "map<" not in f.dataType.simpleString()]
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(*hashed).alias("tie"), F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(m) for c, m in zip(carry, more)])
    sizes = ws.table(sizes.withColumn("class", size_class(F.col("size"))), "sizes")
    classes = ws.table(sizes.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "classes")
    sources = ws.table(targets(ws, classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap, seed), "targets")
    n_classes = classes.count()
    #: (source, class) and source parameters go to all tasks only while they are few; else they are joined by key.
    near = (lambda x: F.broadcast(x)) if n_classes <= broadcast_sources * 64 else (lambda x: x)
    parts = classes.select("source", "class", F.ceil(F.col("n") / stratum).cast("long").alias("parts"))
    key = hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.alias("d").join(near(parts).alias("p"), same("d", "p", "class"))
    rows = rows.select("doc_id", "d.source", "size", "d.class", F.pmod(key, F.col("parts")).alias("part"), key.alias("key"), "tie", "row", *more)
    rows = split(ws, rows, stratum)
    strata = ws.table(rows.groupBy("source", *STRATUM).agg(F.count("*").alias("n")).withColumn("block", F.shiftright("part", 10)), "strata")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = strata.groupBy("source", "class", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("source", "class", "block", ahead(Window.partitionBy("source").orderBy("class", "block")).alias("before"))
    strata = strata.withColumn("within", ahead(Window.partitionBy("source", "class", "block").orderBy("part", "giant", "sub")))
    strata = strata.alias("t").join(blocks.alias("b"), same("t", "b", "class", "block")).join(near(sources).alias("s"), same("t", "s"))
    strata = ws.table(strata.select(F.col("t.source").alias("source"), *[F.col(f"t.{c}").alias(c) for c in STRATUM], (F.col("before") + F.col("within")).alias("ahead"), "source_size", "target", "copies", "start"), "placed")
    within = Window.partitionBy("source", *STRATUM).orderBy("size", "key", "doc_id", "tie", "row")
    rows = rows.withColumn("nth", F.row_number().over(within))
    few = strata if strata.count() > broadcast_sources * 64 else F.broadcast(strata)
    out = rows.alias("r").join(few.alias("t"), same("r", "t", *STRATUM))
    upto = lambda i: F.floor(i.cast("double") * F.col("copies") + F.col("start"))
    index = F.col("ahead") + F.col("nth")
    taken = (upto(index) - upto(index - 1)).cast("long")
    return out.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", taken.alias("copies_taken"), (taken * F.col("size")).alias("taken"), *more)


def repeat_to_targets(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    names = docs.columns
    out = mix(docs, carry=tuple(names), **options).where("copies_taken > 0")
    out = out.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(names)], F.explode(F.sequence(F.lit(1), F.col("copies_taken").cast("int"))).alias("__copy"))
    return out.drop("__copy")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), e AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || rpad(substr(bin(size), 1, 4), 4, '0') AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS key FROM d
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM s0
), s2 AS (
  SELECT *, (words - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM s1
), s3 AS (
  SELECT *, max(rate) OVER () AS level FROM s2
), s AS (
  SELECT source, source_size, least(lim, coalesce(level * weight, lim)) AS target,
         CASE WHEN source_size > 0 THEN least(lim, coalesce(level * weight, lim)) / source_size ELSE 0.0 END AS copies,
         ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM s3
), c AS (
  SELECT source, class, ceil(count(*) / 4096.0)::BIGINT AS parts FROM e GROUP BY source, class
), r AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.source ORDER BY e.class, e.key % c.parts, e.size, e.key, e.doc_id) AS i
  FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source AND e.class = c.class
)
SELECT doc_id, size, source_size, target,
       ((floor(i * copies + start) - floor((i - 1) * copies + start)) * size)::BIGINT AS taken
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
"""

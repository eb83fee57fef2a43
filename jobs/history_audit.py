"""Audit of a moved history: is the target table the source, and if not, where does it differ?

    python -m jobs.history_audit SOURCE TARGET REPORT [--config jobs/history_audit.json]

SOURCE and TARGET are Parquet tables with a key and a text.  REPORT gets

* ``part=record``: a row for each key whose records differ: missing from the target, added to it, or changed, with digests;
* ``part=node``: the roots of both Merkle trees over the ordered records, equal or changed (their digests identify the
  histories), and below a changed root every node that differs;

partitioned by part and problem.  Records are compared as multisets of (key, digest), counted in one shuffle with partial sums, so
repeated keys, null keys and null texts are records like others, and a key with many rows is no group of its own.  Trees are built
over ranges of ranks.  Every run writes the whole report anew: the same tables give the same report.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import ranges
from bitloom.stage import Stage, scratch

log = logging.getLogger("history_audit")

REPORT = "level int, id string, source string, target string, part string, problem string"


def digests(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha): a null text isn't an empty one."""
    return table.select(F.col(key).alias("key"), F.sha2(F.coalesce(F.concat(F.lit("text:"), F.col(text)), F.lit("null")), 256).alias("sha"))


def record_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """(level, id, source, target, part, problem) of keys whose records aren't the same on both sides; digests are the least that one side has more often."""
    both = source.select("key", "sha", F.lit(1).alias("d")).unionByName(target.select("key", "sha", F.lit(-1).alias("d")))
    odd = both.groupBy("key", "sha").agg(F.sum("d").alias("d")).where("d <> 0")
    side = lambda more: F.min(F.when(more, F.col("sha")))
    out = odd.groupBy("key").agg(side(F.col("d") > 0).alias("source"), side(F.col("d") < 0).alias("target"))
    problem = F.when(F.col("target").isNull(), "missing").when(F.col("source").isNull(), "added").otherwise("changed")
    return out.select(F.lit(None).cast("int").alias("level"), F.col("key").cast("string").alias("id"), "source", "target", F.lit("record").alias("part"), problem.alias("problem"))


def node_differences(source: DataFrame, target: DataFrame, fan: int) -> DataFrame:
    """(level, id, source, target, part, problem) of both roots, and of nodes that differ or that one tree lacks."""
    a, b = ranges.tree(source, "key", "sha", fan), ranges.tree(target, "key", "sha", fan)
    top = a.unionByName(b).agg(F.max("level").alias("top"))
    a, b = a.select("level", "node", F.col("sha").alias("source")), b.select("level", "node", F.col("sha").alias("target"))
    both = a.join(b, ["level", "node"], "full_outer").join(F.broadcast(top))  # one row
    same = F.col("source").eqNullSafe(F.col("target"))
    out = both.where(~same | (F.col("level") == F.col("top")))
    return out.select("level", F.col("node").cast("string").alias("id"), "source", "target", F.lit("node").alias("part"), F.when(same, "equal").otherwise("changed").alias("problem"))


def run(spark: SparkSession, source: str, target: str, report: str, config: dict) -> None:
    sides, read, wrote = [], [], Observation()
    with scratch():
        stage = Stage(spark, "audit")
        for path in (source, target):
            read.append(Observation())
            rows = digests(spark.read.parquet(path), config["key"], config["text"]).observe(read[-1], F.count(F.lit(1)).alias("rows"))
            sides.append(stage.write(rows, "digests"))  # texts are read once
        found = record_differences(*sides).unionByName(node_differences(*sides, config["fan"]))
        out = found.observe(wrote, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("part") == "record").alias("records"))
        out.write.mode("overwrite").partitionBy("part", "problem").parquet(report)
    log.info("%d rows read from %s, %d from %s; %d written to %s, %d of them records that differ", read[0].get["rows"], source, read[1].get["rows"], target, wrote.get["rows"], report, wrote.get["records"])


def contents(spark: SparkSession, report: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(report)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("report")
    p.add_argument("--config", default="jobs/history_audit.json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    with open(a.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("history_audit").getOrCreate()
    try:
        run(spark, a.source, a.target, a.report, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

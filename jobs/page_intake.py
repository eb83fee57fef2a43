"""Intake of pages: what is new in a folder of pages is checked, given an owner and a digest, and put into a ledger.

    python -m jobs.page_intake PAGES LEDGER CHECKPOINT [--config jobs/page_intake.json]

PAGES is a folder (or file) of Parquet files (page_id, url, html) that grows.  Each run takes the files that came since the last
one and stops: which ones have been read is kept in CHECKPOINT by the stream itself.  LEDGER gets a row for each different
(page_id, url, content): owner by the longest prefix among the rules, bytes, sha256, and the problems found; it is
partitioned by batch and by whether the page is accepted.  A page that the ledger already has isn't added again, so the ledger holds
the same rows however the files were cut into batches.

A batch that is repeated after a failure writes its own partition anew, and looks only at the partitions before it; so reruns give
the same result.  CHECKPOINT and LEDGER belong together: start both anew, or neither.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import records
from bitloom.operators import score
from bitloom.stage import Stage, scratch

log = logging.getLogger("page_intake")

PAGES = "page_id long, url string, html string"
LEDGER = "page_id long, url string, owner string, bytes long, sha256 string, problems string, batch long, accepted boolean"


def examined(pages: DataFrame, min_chars: int) -> DataFrame:
    """(page_id, url, bytes, sha256, problems), a row for each different page.

    A null or empty html has no bytes and the digest of nothing.
    """
    html = F.coalesce("html", F.lit(""))
    path = F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1)
    holds = {
        "no id": F.col("page_id").isNotNull(),
        "bad url": F.col("url").rlike("^https?://[^/]+/"),
        "unsafe path": records.safe_path(path),
        "no title": html.rlike("<title>[^<]+</title>"),
        "short": F.length(html) >= min_chars,
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in holds.items()]))
    return pages.select("page_id", "url", F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("sha256"), F.concat_ws(",", broken).alias("problems")).distinct()


def owned(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, owner, bytes, sha256, problems, accepted); a null url has no owner."""
    owner = score.owners(pages.select(F.col("url").alias("path")), rules).select("path", "owner")
    out = pages.join(owner, F.col("url").eqNullSafe(F.col("path")), "left")
    return out.select("page_id", "url", "owner", "bytes", "sha256", "problems", (F.col("problems") == "").alias("accepted"))


def just(path: str) -> str:
    """A pattern for this path alone: a stream reads a single file only by a pattern, and a folder also so."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, pages: str, ledger: str, checkpoint: str, config: dict) -> None:
    """Takes what is new in ``pages`` and returns when it is in the ledger."""
    spark.createDataFrame([], LEDGER).write.mode("append").partitionBy("batch", "accepted").parquet(ledger)  # the folder, for the first batch

    def take(new: DataFrame, batch: int) -> None:
        session, came, went = new.sparkSession, Observation(), Observation()
        with scratch():
            rules = session.createDataFrame([tuple(r) for r in config["rules"]], "prefix string, owner string")
            seen = new.observe(came, F.count(F.lit(1)).alias("rows"))
            found = Stage(session, "intake").write(examined(seen, config["min_chars"]), "examined")  # html is read once
            known = session.read.schema(LEDGER).parquet(ledger).where(F.col("batch") < batch).select(F.col("page_id").alias("k"), F.col("url").alias("u"), F.col("sha256").alias("s"))
            fresh = found.join(known, F.col("page_id").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("sha256") == F.col("s")), "left_anti")
            out = owned(fresh, rules).withColumn("batch", F.lit(batch).cast("long"))
            out = out.observe(went, F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "accepted").parquet(ledger)
        log.info("batch %d: %d rows read from %s, %d written to %s, %d of them accepted", batch, came.get["rows"], pages, went.get["rows"], ledger, went.get["accepted"])

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(just(pages))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: nothing new is left", pages)


def contents(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger, without the batches that rows came in."""
    return spark.read.schema(LEDGER).parquet(ledger).drop("batch")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("pages")
    p.add_argument("ledger")
    p.add_argument("checkpoint")
    p.add_argument("--config", default="jobs/page_intake.json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    with open(a.config) as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("page_intake").getOrCreate()
    try:
        run(spark, a.pages, a.ledger, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

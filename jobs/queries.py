"""The jobs as queries over whole tables: each runs twice into one new folder, and returns what stands there after that."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom import own_folder
from bitloom.queries_links import tree_sql

from . import history_audit, page_intake


def config(name: str) -> dict:
    return json.loads(resources.files(__package__).joinpath(f"{name}.json").read_text())


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "job1")
    for _ in range(2):
        page_intake.run(spark, f"{sf_dir}/pages.parquet", f"{folder}/ledger", f"{folder}/checkpoint", config("page_intake"))
    return page_intake.contents(spark, f"{folder}/ledger")


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target lacks, alters and adds some documents."""
    folder, k = own_folder(spark, "job2"), F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    moved = docs.where(k % 197 != 104).withColumn("text", F.when(k % 101 == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    moved.unionByName(docs.where(k % 211 == 5).withColumn("doc_id", -1 - k)).write.parquet(f"{folder}/target")
    for _ in range(2):
        history_audit.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/target", f"{folder}/report", config("history_audit"))
    return history_audit.contents(spark, f"{folder}/report")


def rules_sql() -> str:
    return ", ".join(f"('{prefix}', '{owner}')" for prefix, owner in config("page_intake")["rules"])


JOB1_SQL = rf"""WITH r(prefix, owner) AS (VALUES {rules_sql()}), p AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages),
x AS (SELECT DISTINCT page_id, url, strlen(html) AS bytes, sha256(html) AS sha256, concat_ws(',', CASE WHEN page_id IS NULL THEN 'no id' END, CASE WHEN NOT coalesce(regexp_matches(url, '^https?://[^/]+/'), false) THEN 'bad url' END,
  CASE WHEN url IS NULL OR len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0 OR regexp_matches(path, '[*?\[\]\\]') THEN 'unsafe path' END,
  CASE WHEN NOT regexp_matches(html, '<title>[^<]+</title>') THEN 'no title' END, CASE WHEN length(html) < {config("page_intake")["min_chars"]} THEN 'short' END) AS problems FROM p)
SELECT page_id, url, (SELECT arg_max(owner, (length(prefix), owner)) FROM r WHERE starts_with(url, prefix)) AS owner, bytes, sha256, problems, problems = '' AS accepted FROM x"""


def side_sql(name: str, docs: str) -> str:
    """CTE ``name``: nodes of the tree over documents as ``docs`` has them."""
    levels = tree_sql("sha256(coalesce('text:' || text, 'null'))", config("history_audit")["fan"]).replace("FROM documents", f"FROM {docs}")
    return f"{name} AS (WITH {levels} SELECT * FROM nodes)"


JOB2_SQL = f"""WITH s AS (SELECT doc_id, text FROM documents), t AS (SELECT doc_id, CASE WHEN doc_id % 101 = 7 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 197 <> 104 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 211 = 5),
{side_sql("a", "s")}, {side_sql("b", "t")},
x AS (SELECT doc_id, sha256(coalesce('text:' || text, 'null')) AS source FROM s), y AS (SELECT doc_id, sha256(coalesce('text:' || text, 'null')) AS target FROM t),
n AS (SELECT level, node, a.sha AS source, b.sha AS target FROM a FULL JOIN b USING (level, node))
SELECT NULL::INTEGER AS level, doc_id::VARCHAR AS id, source, target, 'record' AS part, CASE WHEN target IS NULL THEN 'missing' WHEN source IS NULL THEN 'added' ELSE 'changed' END AS problem FROM x FULL JOIN y USING (doc_id) WHERE source IS DISTINCT FROM target
UNION ALL SELECT level, node::VARCHAR, source, target, 'node', CASE WHEN source = target THEN 'equal' ELSE 'changed' END FROM n WHERE source IS DISTINCT FROM target OR level = (SELECT max(level) FROM n)"""

QUERIES = {"job1_page_intake": job1, "job2_history_audit": job2}
SQL = {"job1_page_intake": JOB1_SQL, "job2_history_audit": JOB2_SQL}

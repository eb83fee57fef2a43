"""Queries of file sources and sinks: each writes a table as files of one kind to the shared folder, and reads them back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from . import own_folder
from .queries import query, table
from .sources import files


@query("s07_registry", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def s07(spark, sf_dir):
    """The one record of a registry with a given key."""
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").toLocalIterator()]  # 25 nations
    path = own_folder(spark, "registry") + "/registry.json"
    files.write_canonical(spark, {"id": "nations", "records": rows}, path)
    return files.registry(spark, path, "id string, records array<struct<n_nationkey: int, n_name: string, n_regionkey: int>>", "records", F.col("n_nationkey") == 7)


@query("s08_receipts", "SELECT c_nationkey AS nation, count(*) AS customers, min(c_custkey) AS first, 'region-' || n_regionkey || '/nation-' || c_nationkey || '.receipt.json' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, n_regionkey")
def s08(spark, sf_dir):
    """One receipt a nation, in a folder for each region, with other files between them."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    done = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").groupBy("c_nationkey", "n_regionkey").agg(F.count("*").alias("customers"), F.min("c_custkey").alias("first"))
    root = own_folder(spark, "receipts")
    for r in done.toLocalIterator():  # one for each of 25 nations
        where = f"{root}/region-{r['n_regionkey']}/nation-{r['c_nationkey']}"
        files.write_canonical(spark, {"nation": r["c_nationkey"], "customers": r["customers"], "first": r["first"]}, where + ".receipt.json")
        files.write_bytes(spark, where + ".txt", b"not a receipt")
    found = files.receipts(spark, root, "nation int, customers long, first long", "*.receipt.json")
    return found.select("nation", "customers", "first", F.regexp_extract("path", "(region-[^/]*/[^/]*)$", 1).alias("path"))


@query("s09_archive_members", "SELECT item_id, 'items/' || item_id || '.txt' AS member, sha256(text) AS sha FROM benchmark")
def s09(spark, sf_dir):
    """Benchmark items as members of archives, a few hundred each."""

    def archives(frames):
        import pandas as pd

        for f in frames:
            for i in range(0, len(f), 200):
                part, raw = f.iloc[i : i + 200], io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("items/", b"")
                    for item, text in zip(part["item_id"], part["text"]):
                        z.writestr(f"items/{item}.txt", text.encode())
                yield pd.DataFrame({"name": [f"from-{part['item_id'].iloc[0]}.zip"], "content": [raw.getvalue()]})

    root = own_folder(spark, "archives")
    made = table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(archives, "name string, content binary")
    files.write_files(spark, root, ((r["name"], bytes(r["content"])) for r in made.toLocalIterator()))  # one archive at a time
    found = files.archive_members(spark, root)
    return found.select(F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long").alias("item_id"), "member", F.sha2("content", 256).alias("sha"))


@query(
    "s10_strict_rows",
    "WITH l AS (SELECT event_id, event_id % 10 = 3 AS bad, event_id % 11 = 5 AND event_id % 10 <> 3 AS extra, event_id % 97 = 8 AS twice FROM events), g AS (SELECT event_id FROM l WHERE NOT bad AND NOT extra)"
    " SELECT event_id AS ordinal, 'rejected' AS problem FROM l WHERE bad OR extra UNION ALL SELECT event_id, 'gap before' FROM g WHERE event_id > 0 AND event_id - 1 NOT IN (SELECT event_id FROM g)"
    " UNION ALL SELECT event_id, 'repeated' FROM l WHERE NOT bad AND NOT extra AND twice",
)
def s10(spark, sf_dir):
    """Events as lines, some with a value of another type, an unknown key or twice: what a strict reader says of each."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    k = F.col("event_id")
    line = F.when(k % 10 == 3, F.to_json(F.struct(F.concat(F.lit("e"), k).alias("event_id"), "event_type")))
    line = line.when(k % 11 == 5, F.to_json(F.struct("event_id", "event_type", F.lit(1).alias("more")))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    lines = e.select(F.explode(F.when(k % 97 == 8, F.array(line, line)).otherwise(F.array(line))).alias("value"))
    root = own_folder(spark, "lines")
    lines.write.text(root)
    good, bad = files.strict_rows(spark, root, "event_id long, event_type string")
    rejected = bad.select(F.regexp_extract("value", r'"event_id":"?e?(\d+)', 1).cast("long").alias("ordinal"), F.lit("rejected").alias("problem"))
    return rejected.distinct().unionByName(files.ordinal_problems(good, "event_id"))


@query("s11_time_reports", "SELECT n_nationkey * 3601.5::DOUBLE AS seconds, (1000 + n_nationkey * 17)::BIGINT AS kibibytes FROM nation")
def s11(spark, sf_dir):
    """Resource reports as text, with clocks of minutes and of hours."""

    def report(k):
        t = k * 3601.5
        clock = f"{int(t // 3600)}:{int(t % 3600 // 60):02d}:{t % 60:05.2f}" if t >= 3600 else f"{int(t // 60)}:{t % 60:05.2f}"
        return f"\tElapsed (wall clock) time (h:mm:ss or m:ss): {clock}\n\tMaximum resident set size (kbytes): {1000 + k * 17}\n".encode()

    root = own_folder(spark, "reports")
    keys = table(spark, sf_dir, "nation").select("n_nationkey").toLocalIterator()
    files.write_files(spark, root, ((f"{r[0]}.txt", report(r[0])) for r in keys))
    return files.time_report(spark, root)


@query("s12_canonical_sink", """SELECT sha256('{' || chr(10) || '  "id": "regions",' || chr(10) || '  "names": [' || chr(10) || string_agg('    "' || r_name || '"', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || '  ]' || chr(10) || '}' || chr(10)) AS sha FROM region""")
def s12(spark, sf_dir):
    names = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").toLocalIterator()]  # five
    path = own_folder(spark, "canonical") + "/regions.json"
    files.write_canonical(spark, {"names": names, "id": "regions"}, path)
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha"))


@query(
    "s13_projection",
    """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS full_sha256, n_nationkey % 4 <> 1 AND n_nationkey % 5 <> 2 AS points FROM nation""",
)
def s13(spark, sf_dir):
    """Compact records against full ones of which some were changed, in a projected field or another."""
    full = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    compact = files.project(full, ["n_nationkey", "n_name"])
    k = F.col("n_nationkey")
    later = full.withColumn("n_name", F.when(k % 4 == 1, F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name")))
    later = later.withColumn("n_regionkey", F.when(k % 5 == 2, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")))
    return compact.select("n_nationkey", "full_sha256").join(files.points_at(compact, later, "n_nationkey"), "n_nationkey")


FILE_SQL = "SELECT 'r' || n_regionkey || '/' || n_nationkey || '.txt' AS path, octet_length(encode(n_name || repeat('.', n_nationkey)))::BIGINT AS bytes, sha256(n_name || repeat('.', n_nationkey)) AS sha256 FROM nation"


def nation_files(spark, sf_dir):
    for r in table(spark, sf_dir, "nation").toLocalIterator():
        yield f"r{r['n_regionkey']}/{r['n_nationkey']}.txt", (r["n_name"] + "." * r["n_nationkey"]).encode()


@query("s14_manifest", FILE_SQL)
def s14(spark, sf_dir):
    root = own_folder(spark, "tree")
    files.write_files(spark, root, nation_files(spark, sf_dir))
    return files.manifest(spark, root)


@query("s14_tarball", f"SELECT *, true AS deterministic FROM ({FILE_SQL})")
def s14_tar(spark, sf_dir):
    """The same files through an archive, built twice in different orders."""
    small = list(nation_files(spark, sf_dir))  # 25 files
    data = files.tarball(small)
    path = own_folder(spark, "tarball") + "/tree.tar.gz"
    files.write_bytes(spark, path, data)
    found = files.tar_members(spark, path).select(F.col("member").alias("path"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return found.withColumn("deterministic", F.lit(files.tarball(reversed(small)) == data))

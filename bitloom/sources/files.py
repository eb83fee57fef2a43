"""JSON, archive and text sources, and deterministic sinks.

Files are written by Hadoop's file systems, so a path may be on any storage that Spark reads.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import canonical


def registry(spark: SparkSession, path: str, schema: str, records: str, where: Column) -> DataFrame:
    """The one record of a registry file that meets a condition; any other number is an error."""
    r = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = r.select(F.explode(records).alias("record")).select("record.*").where(where)
    n = len(found.take(2))
    if n != 1:
        raise ValueError(f"expected one record, found {'none' if not n else 'several'}")
    return found


def receipts(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """All JSON files below a folder, with their paths."""
    r = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "FAILFAST")
    return r.json(root).select("*", F.col("_metadata.file_path").alias("path"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of ZIP files."""

    def run(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.namelist():  # one member in memory at a time
                        if not m.endswith("/"):
                            yield pd.DataFrame([(name, m, z.read(m))], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def only_member(members: DataFrame, suffix: str) -> DataFrame:
    """The one member with a suffix."""
    found = members.where(F.endswith("member", F.lit(suffix)))
    if len(found.take(2)) != 1:
        raise ValueError(f"expected one member ending in {suffix}")
    return found


def strict_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines that fit the schema, and the lines that don't."""
    options = {"columnNameOfCorruptRecord": "corrupt"}
    t = spark.read.text(path).select("value", F.from_json("value", f"{schema}, corrupt string", options).alias("r"), F.json_object_keys("value").alias("keys"))
    names = [f.name for f in t.schema["r"].dataType if f.name != "corrupt"]
    extra = F.array_except(F.coalesce("keys", F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    fits = F.col("r").isNotNull() & F.col("r.corrupt").isNull() & (F.size(extra) == 0)
    return t.where(fits).select("r.*").drop("corrupt"), t.where(~fits).select("value")


def time_report(spark: SparkSession, path: str) -> DataFrame:
    """(seconds, kibibytes) scraped from resource reports."""
    t = spark.read.text(path, wholetext=True)
    clock = F.regexp_extract("value", r"Elapsed \(wall clock\) time \(h:mm:ss or m:ss\): ([0-9:.]+)", 1)
    part = lambda i: F.coalesce(F.regexp_extract(clock, r"^(?:(\d+):)?(\d+):([\d.]+)$", i).try_cast("double"), F.lit(0.0))
    return t.select((part(1) * 3600 + part(2) * 60 + part(3)).alias("seconds"), F.regexp_extract("value", r"Maximum resident set size \(kbytes\): (\d+)", 1).cast("long").alias("kibibytes"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_files(spark: SparkSession, root: str, files: Iterable[tuple[str, bytes]]) -> None:
    """(relative path, content) of small files, one at a time."""
    for name, data in files:
        write_bytes(spark, f"{root.rstrip('/')}/{name}", data)


def pretty(record) -> str:
    """Sorted, indented, ASCII, one newline at the end."""
    return json.dumps(record, sort_keys=True, indent=2, ensure_ascii=True, allow_nan=False) + "\n"


def write_canonical(spark: SparkSession, record, path: str) -> None:
    write_bytes(spark, path, pretty(record).encode("ascii"))


def ordinal_problems(rows: DataFrame, ordinal: str, first: int = 0) -> DataFrame:
    """(ordinal, problem): ordinals that occur twice, and those whose predecessor is missing."""
    seen = rows.groupBy(F.col(ordinal).alias("ordinal")).agg(F.count("*").alias("n"))
    before = seen.select((F.col("ordinal") + 1).alias("ordinal"))
    repeated = seen.where("n > 1").select("ordinal", F.lit("repeated").alias("problem"))
    gaps = seen.where(F.col("ordinal") > first).join(before, "ordinal", "left_anti").select("ordinal", F.lit("gap before").alias("problem"))
    return repeated.unionByName(gaps)


def full_digest(full: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(full.columns))), 256)


def project(full: DataFrame, paths: list[str], digest: str = "full_sha256") -> DataFrame:
    """A compact record: some fields, and the digest of the whole."""
    return full.select(*[F.col(p).alias(p.replace(".", "_")) for p in paths], full_digest(full).alias(digest))


def points_at(compact: DataFrame, full: DataFrame, key: str, digest: str = "full_sha256") -> DataFrame:
    """(key, points): whether each compact record names the full one's digest and has its fields."""
    shared = [c for c in compact.columns if c in full.columns and c != key]
    f = full.select(F.col(key), full_digest(full).alias("__sha"), *[F.col(c).alias(f"__{c}") for c in shared])
    same = F.col(digest) == F.col("__sha")
    for c in shared:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return compact.join(f, key, "left").select(key, F.coalesce(same, F.lit(False)).alias("points"))


def manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files below a folder, paths relative to it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return f.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tarball(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A compressed archive that depends on names and contents alone: sorted, without times and owners."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in sorted(files):
            entry = tarfile.TarInfo(name)
            entry.size, entry.mode = len(data), 0o644
            t.addfile(entry, io.BytesIO(data))
    return gzip.compress(raw.getvalue(), mtime=0)


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content) of compressed tar files, read member by member."""

    def run(frames):
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame([(name, m.name, t.extractfile(m).read())], columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


__all__ = ["archive_members", "canonical", "manifest", "only_member", "ordinal_problems", "points_at", "pretty", "project", "receipts", "registry", "strict_rows", "tar_members", "tarball", "time_report", "write_bytes", "write_canonical", "write_files"]

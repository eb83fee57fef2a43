"""Shared pieces of the training-data operators.

Words are maximal runs of bytes other than space and TAB..CR; ``bytes.split()``
splits on exactly these six bytes, so Python code uses it on UTF-8 text.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import own_folder

#: One word, for Spark SQL functions.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


class Workspace:
    """Tables that cut lineage, written to the shared folder.

    Losing an executor costs at most the tasks since the last table: what was
    written is read again from shared storage, never recomputed.  Results are
    lazy and read these tables, so they stay until a caller that has written the
    result deletes them (``scratch``).
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = own_folder(spark, name)
        self.n = 0
        Workspace.opened.append(self)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._bitloom_path = path
        return out

    def close(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._bitloom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """Deletes at its end the tables that operators wrote inside, for callers that have written what they need."""
    before, Workspace.opened = Workspace.opened, []
    try:
        yield
    finally:
        for w in Workspace.opened:
            w.close()
        Workspace.opened = before


def map_all(docs: DataFrame, run, added: dict[str, str]) -> DataFrame:
    """mapInArrow over all columns, whatever their names, with columns added at the end (name: type)."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"x{i} {kind}" for i, kind in enumerate(added.values())]
    return plain.mapInArrow(run, ", ".join(fields)).toDF(*docs.columns, *added)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training(remainder: int, modulus: int, doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id counts as 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with good avalanche (xor-shift, odd multiplier)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """64-bit hash of a word; a bounded cache, cleared when full."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, nulls as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def groups(batches, key: int):
    """Tables of rows with one key, from batches sorted by it."""
    import pyarrow as pa

    open_: list = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cut.tolist(), len(k)]
        for i, j in zip(edges, edges[1:]):
            if open_ and open_[-1].column(key)[0].as_py() != k[i]:
                yield pa.concat_tables(open_)
                open_ = []
            open_.append(t.slice(i, j - i))
    if open_:
        yield pa.concat_tables(open_)


def small(batches, text: int, most: int = 4_000_000):
    """Batches cut so that the column ``text`` holds about ``most`` bytes in each, to bound a task's memory."""
    import pyarrow.compute as pc

    for b in batches:
        if b.num_rows:
            size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size, dtype=np.int64) // most
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:]):
                yield b.slice(i, j - i)


def slices(texts: list[bytes], most: int = 2_000_000):
    """Stretches of texts of about ``most`` bytes, to bound a task's memory; a longer text is one by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)

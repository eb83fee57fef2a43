"""Tables on the way of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from . import own_folder


class Stage:
    """Writes intermediate results and reads them back, so that lineage stays short and lost executors cost little.

    Tables live as long as results that read them lazily; ``drop`` deletes those that nothing reads any more, and ``scratch``
    all that operators made inside it.
    """

    opened: list[Stage] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, own_folder(spark, name), 0
        Stage.opened.append(self)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._bitloom_path = path
        return out

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._bitloom_path)


@contextmanager
def scratch():
    """For callers that have written what they need by its end: deletes the tables that operators made inside."""
    before, Stage.opened = Stage.opened, []
    try:
        yield
    finally:
        for s in Stage.opened:
            s._delete(s.root)
        Stage.opened = before

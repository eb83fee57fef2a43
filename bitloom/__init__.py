"""Exact, deterministic analytics over finite bit-vector relations on PySpark."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode alone, where all share one machine, a folder is made and set if the session has none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bitloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_folder(spark, name: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_folder(spark)}/bitloom/{name}-{uuid.uuid4().hex[:12]}"


def cut(df):
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ship(spark) -> None:
    """Gives this package to the Python workers of a session, once, so that they needn't have it installed.

    The archive holds code only; Spark itself copies it to the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_bitloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="bitloom-")) / "bitloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._bitloom_shipped = True
